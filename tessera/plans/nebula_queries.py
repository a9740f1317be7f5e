"""The cloud that each vector's densities make; its march has no form in SQL that ends, and is tested ray by ray."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import nebula
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def frames(spark, d):
    """Every vector as a grid of 4 by 4 by 4 densities, seen by a camera that goes round with its number, before a scene whose depth it gives too."""
    angle = F.col("vec_id") * 0.37
    s, c = F.sin(angle), F.cos(angle)
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    e = V.table(spark, d, "embeddings").where(F.size("embedding") == 64)
    return e.select(
        F.col("vec_id").alias("frame"),
        F.transform("embedding", lambda v: unit(0.3 + v.cast("double") * 3)).alias("density"),
        F.lit(4).alias("side"),
        F.array(-s * 10, F.lit(0.5), -c * 10).alias("camera"),
        F.array(s, F.lit(-0.05), c).alias("forward"),
        F.array(c, F.lit(0.0), -s).alias("right"),
        F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("up"),
        F.transform("embedding", lambda v: unit(0.45 + v.cast("double") * 2) * 0.5).alias("depth"),
    )


@query("px_nebula")
def px_nebula(spark, d):
    made = nebula.render(frames(spark, d), 8, 8)
    at = made.select("frame", "rgba", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    channels = [F.round(F.get("rgba", F.col("i") * 4 + k), 9).alias(n) for k, n in enumerate("rgba")]
    return at.select("frame", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), *channels)

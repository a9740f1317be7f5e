"""What a source shows and is lit by, voted by its samples, and the frames that are worth a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of the analysed time at which anchors stand, and the priorities of the kinds of frames.
ANCHORS = (0.15, 0.35, 0.65, 0.85)
ESCALATION, DESCRIPTOR, EXTREME, ANCHOR = 0, 1, 2, 3
DESCRIPTORS = ("avoid_heavy_grade", "grade_confidence_low")


def _clipped(top: float, base: float, slope: float, rate: Column, from_: float) -> Column:
    return F.least(F.lit(top), base + slope * F.least(F.lit(1.0), (rate - from_) / (1 - from_)))


def scene_labels(samples: DataFrame) -> DataFrame:
    """Samples (src, luma, skin, colours) to (src, place, place_conf, light, light_conf).

    ``colours`` are structs (r, g, b), the most frequent first. Any sky, foliage or cool colour of a sample is a vote for outdoors, a warm first one for a lamp. Without
    skin in the picture both labels are a little less sure.
    """
    any_ = lambda f: F.coalesce(F.exists("colours", f), F.lit(False)).cast("int")
    sky = any_(lambda c: (c["b"] > c["r"] + 0.06) & (c["b"] > c["g"] + 0.06) & (c["b"] > 0.35))
    leaf = any_(lambda c: (c["g"] > c["r"] + 0.05) & (c["g"] > c["b"] + 0.05) & (c["g"] > 0.30))
    cool = any_(lambda c: (F.greatest(c["g"], c["b"]) > c["r"] + 0.06) & (F.greatest(c["g"], c["b"]) > 0.35))
    first = F.get("colours", F.lit(0))
    warm = F.coalesce((first["r"] > first["b"] + 0.08) & (first["r"] > first["g"] + 0.03), F.lit(False)).cast("int")
    rates = samples.groupBy("src").agg(F.avg("luma").alias("luma"), F.avg("skin").alias("skin"), F.greatest(F.avg(sky), F.avg(leaf), F.avg(cool)).alias("cue"), F.avg(warm).alias("warm"))
    luma, skin, cue, tungsten = (F.col(c) for c in ("luma", "skin", "cue", "warm"))
    place = F.when((luma > 0.30) & (cue > 0.35), "outdoor").when((luma < 0.28) & (tungsten > 0.45), "indoor").otherwise("unknown")
    q = rates.withColumn("place", place)
    sure = F.when(F.col("place") == "outdoor", _clipped(0.95, 0.55, 0.4, cue, 0.35)).when(F.col("place") == "indoor", _clipped(0.9, 0.55, 0.35, tungsten, 0.45)).otherwise(0.2)
    q = q.withColumn("sure", sure)
    lit = (
        F.when(F.col("place") == "outdoor", F.struct(F.lit("natural").alias("label"), F.least(F.lit(0.95), F.greatest("sure", F.lit(0.6))).alias("conf")))
        .when((F.col("place") == "indoor") & (tungsten > 0.5), F.struct(F.lit("artificial").alias("label"), F.least(F.lit(0.9), 0.6 + 0.3 * tungsten).alias("conf")))
        .when(F.col("place") == "indoor", F.struct(F.lit("mixed").alias("label"), F.lit(0.55).alias("conf")))
        .when((tungsten > 0.55) & (luma < 0.30), F.struct(F.lit("artificial").alias("label"), F.lit(0.6).alias("conf")))
        .when((cue > 0.60) & (luma > 0.35), F.struct(F.lit("natural").alias("label"), F.lit(0.6).alias("conf")))
        .otherwise(F.struct(F.lit("unknown").alias("label"), F.lit(0.2).alias("conf")))
    )
    less = F.when(skin < 0.02, 0.1).otherwise(0.0)
    return q.withColumn("lit", lit).select("src", "place", F.greatest(F.lit(0.0), F.col("sure") - less).alias("place_conf"), F.col("lit.label").alias("light"), F.greatest(F.lit(0.0), F.col("lit.conf") - less).alias("light_conf"))


def evidence_frames(samples: DataFrame, descriptors: DataFrame, escalations: DataFrame, budget: int) -> DataFrame:
    """The frames (src, n, ms, priority, tags) that judge a source, at most ``budget``.

    Samples are (src, t, pos, luma), descriptors (src, label, start, end), escalations (src, t). Asked for frames come first, then the middle of
    descriptors that warn of heavy grading, the darkest, brightest and middle sample, and anchors over the analysed time. Requests for the same millisecond are one, with
    all tags and the best priority. Times before 0 or not finite are left out.
    """
    s = samples.groupBy("src").agg(F.min(F.struct("luma", "t", "pos")).alias("dark"), F.min(F.struct((-F.col("luma")).alias("minus"), "t", "pos")).alias("bright"), F.max("t").alias("end"), F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy("t", "pos")) - 1
    middle = samples.withColumn("nth", nth).join(s.select("src", "n"), "src").where(F.col("nth") == F.floor(F.col("n") / 2)).select("src", "t")
    ask = lambda t, tag, priority: F.struct(t.cast("double").alias("t"), tag.alias("tag"), F.lit(priority).alias("priority"))
    fixed = [ask(F.col("dark.t"), F.lit("min_luma"), EXTREME), ask(F.col("bright.t"), F.lit("max_luma"), EXTREME)]
    anchors = [F.when(F.col("end") > 0, ask(F.col("end") * share, F.lit("anchor"), ANCHOR)) for share in ANCHORS]
    asked = (
        s.select("src", F.explode(F.array_compact(F.array(*fixed, *anchors))).alias("a"))
        .unionByName(middle.select("src", ask(F.col("t"), F.lit("midpoint"), EXTREME).alias("a")))
        .unionByName(descriptors.where(F.col("label").isin(*DESCRIPTORS)).select("src", ask((F.col("start") + F.col("end")) * 0.5, F.col("label"), DESCRIPTOR).alias("a")))
        .unionByName(escalations.select("src", ask(F.col("t"), F.lit("escalation"), ESCALATION).alias("a")))
        .select("src", "a.*")
        .where((F.col("t") >= 0) & (F.col("t") < float("inf")))
    )
    one = asked.groupBy("src", F.round(F.col("t") * 1000).cast("long").alias("ms")).agg(F.min("priority").alias("priority"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    n = F.row_number().over(Window.partitionBy("src").orderBy("priority", "ms", "tags"))
    return one.withColumn("n", n).where(F.col("n") <= budget).select("src", "n", "ms", "priority", "tags")

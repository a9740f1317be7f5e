"""Voices, tracks and masks over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import clustering as C
from tessera.operators import temporal as T
from tessera.operators.masks import propagate_masks
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def voices(spark, d):
    """Voice windows: vectors in the order of their numbers, a source for each label."""
    return V.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("src"), F.col("vec_id").alias("key"), F.col("vec_id").cast("double").alias("mid"), F.col("embedding").cast("array<double>").alias("vector"))


@query("agglomerative_clusters")
def agglomerative_clusters(spark, d):
    return C.clusters(voices(spark, d), threshold=0.3)


@query("small_cluster_merge")
def small_cluster_merge(spark, d):
    w = voices(spark, d)
    return C.absorb_small(C.cluster_sums(w, C.clusters(w, threshold=0.5)), threshold=0.5)


@query("high_similarity_collapse")
def high_similarity_collapse(spark, d):
    w = voices(spark, d)
    return C.collapse_alike(C.cluster_sums(w, C.clusters(w, threshold=0.6)), threshold=0.45)


@query(
    "cluster_speakers",
    V.ctes("faces", "samples") + """, a AS (SELECT DISTINCT src, 'C' || (pos % 4)::VARCHAR AS cluster FROM samples), f AS (SELECT src, min(track) AS only_, max(track) AS other FROM faces WHERE src > 2 OR track = 'T1' GROUP BY src)
      SELECT src, cluster, CASE WHEN only_ = other THEN only_ ELSE cluster END AS speaker FROM a LEFT JOIN f USING (src)""",
)
def cluster_speakers(spark, d):
    a = V.samples(spark, d).select("src", F.concat(F.lit("C"), (F.col("pos") % 4).cast("string")).alias("cluster"))
    return C.cluster_speakers(a, V.faces(spark, d).where("src > 2 or track = 'T1'"))


@query(
    "word_clusters",
    V.ctes("words", "samples") + """ SELECT word_id, 'C' || (pos % 4)::VARCHAR AS cluster, round(dt, 6) AS dt FROM (SELECT w.word_id, s.pos, abs(s.t - w.t) AS dt,
      row_number() OVER (PARTITION BY w.word_id ORDER BY abs(s.t - w.t), s.t, s.pos) AS n FROM words w JOIN samples s ON s.src = w.src) q WHERE n = 1""",
)
def word_clusters(spark, d):
    """The cluster of the voice window nearest to each word, however far; the earlier one on a tie."""
    near = T.asof_bracket(V.words(spark, d), V.samples(spark, d), by="src", t="t", key="word_id", pos="pos", later_wins=False).where("pos is not null")
    return near.select("word_id", F.concat(F.lit("C"), (F.col("pos") % 4).cast("string")).alias("cluster"), F.round("dt", 6).alias("dt"))


_SAID = """CASE WHEN word_id % 11 = 0 THEN NULL WHEN word_id % 13 = 0 THEN 'OFFSCREEN' WHEN word_id % 50 = 7 THEN 'R' || (word_id % 3)::VARCHAR ELSE 'S' || (word_id % 5)::VARCHAR END"""


@query(
    "rare_speakers",
    V.ctes("words") + f""", s AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY word_id) AS i, {_SAID} AS speaker FROM words),
      k AS (SELECT src, speaker, count(*) AS n FROM s WHERE speaker IS NOT NULL AND speaker <> 'OFFSCREEN' GROUP BY ALL), q AS (SELECT *, count(*) OVER (PARTITION BY src) AS kinds, sum(n) OVER (PARTITION BY src) AS total FROM k),
      rare AS (SELECT src, speaker FROM q WHERE kinds >= 5 AND n <= greatest(2, ceil(total * 0.03::DOUBLE))),
      m AS (SELECT s.*, rare.speaker IS NOT NULL AS rare, CASE WHEN rare.speaker IS NULL AND s.speaker IS NOT NULL AND s.speaker <> 'OFFSCREEN' THEN i END AS ok FROM s LEFT JOIN rare ON rare.src = s.src AND rare.speaker = s.speaker),
      b AS (SELECT *, min(ok) OVER (PARTITION BY src ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM m), c AS (SELECT b.*, z.speaker AS nxs FROM b LEFT JOIN s z ON z.src = b.src AND z.i = b.nx),
      r AS (SELECT src, i, CASE WHEN rare THEN coalesce(nxs, 'OFFSCREEN') ELSE speaker END AS said, CASE WHEN CASE WHEN rare THEN nxs ELSE speaker END <> 'OFFSCREEN' THEN i END AS li, CASE WHEN CASE WHEN rare THEN nxs ELSE speaker END <> 'OFFSCREEN' THEN CASE WHEN rare THEN nxs ELSE speaker END END AS ls FROM c WHERE i = 1
        UNION ALL SELECT src, i, said, CASE WHEN said IS NOT NULL AND said <> 'OFFSCREEN' THEN i ELSE li END, CASE WHEN said IS NOT NULL AND said <> 'OFFSCREEN' THEN said ELSE ls END FROM
          (SELECT c.src, c.i, r.li, r.ls, CASE WHEN NOT c.rare THEN c.speaker WHEN r.li IS NOT NULL AND (c.nx IS NULL OR c.i - r.li <= c.nx - c.i) THEN r.ls ELSE coalesce(c.nxs, 'OFFSCREEN') END AS said FROM r JOIN c ON c.src = r.src AND c.i = r.i + 1) x)
      SELECT src, i, said AS speaker FROM r""",
)
def rare_speakers(spark, d):
    w = V.words(spark, d)
    n = F.row_number().over(Window.partitionBy("src").orderBy("word_id")).cast("long")
    name = lambda p, k: F.concat(F.lit(p), (F.col("word_id") % k).cast("string"))
    said = F.when(F.col("word_id") % 11 == 0, None).when(F.col("word_id") % 13 == 0, "OFFSCREEN").when(F.col("word_id") % 50 == 7, name("R", 3)).otherwise(name("S", 5))
    return C.reassign_rare(w.select("src", n.alias("i"), said.alias("speaker")))


@query(
    "track_motion",
    V.ctes("faces") + """, l AS (SELECT *, lag(x + w / 2) OVER q AS px, lag(y + h / 2) OVER q AS py, lag(w) OVER q AS pw, lag(h) OVER q AS ph FROM faces WINDOW q AS (PARTITION BY src, track ORDER BY t, pos))
      SELECT pos, track, round(coalesce(sqrt(power(x + w / 2 - px, 2) + power(y + h / 2 - py, 2) + 0.5 * (power(w - pw, 2) + power(h - ph, 2))), 0), 9) AS motion FROM l""",
)
def track_motion(spark, d):
    """How far each face has come since its track was last seen, whatever lies between; 0 at first."""
    seen = Window.partitionBy("src", "track").orderBy("t", "pos")
    moved = lambda c: F.pow(c - F.lag(c).over(seen), 2)
    far = F.sqrt(moved(F.col("x") + F.col("w") / 2) + moved(F.col("y") + F.col("h") / 2) + 0.5 * (moved(F.col("w")) + moved(F.col("h"))))
    return V.faces(spark, d).select("pos", "track", F.round(F.coalesce(far, F.lit(0.0)), 9).alias("motion"))


@query(
    "stable_indices",
    V.ctes("faces") + """, f AS (SELECT src, track, min(row(t, pos, x, y, w, h)) AS first FROM faces GROUP BY src, track)
      SELECT src, track, 'P' || (row_number() OVER (PARTITION BY src ORDER BY first, track) - 1)::VARCHAR AS person FROM f""",
)
def stable_indices(spark, d):
    """Tracks numbered by the frame and place where they were first seen."""
    first = V.faces(spark, d).groupBy("src", "track").agg(F.min(F.struct("t", "pos", "x", "y", "w", "h")).alias("first"))
    n = F.row_number().over(Window.partitionBy("src").orderBy("first", "track")) - 1
    return first.select("src", "track", F.concat(F.lit("P"), n.cast("string")).alias("person"))


@query(
    "track_evidence",
    V.ctes("samples", "faces") + """, s AS (SELECT p.src, p.t, p.pos, list_sort(list(f.track) FILTER (f.track IS NOT NULL)) AS ids FROM samples p LEFT JOIN faces f USING (pos) GROUP BY ALL),
      l AS (SELECT *, last_value(ids IGNORE NULLS) OVER (PARTITION BY src ORDER BY t, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
      r AS (SELECT *, coalesce(len(ids), 0) AS n, ids IS NOT NULL AND prev IS NOT NULL AND NOT list_has_any(prev, ids) AS again FROM l)
      SELECT pos, n, again AS reacquired, round(CASE WHEN n = 0 THEN CASE WHEN prev IS NULL THEN 0 ELSE 0.25 END ELSE CASE WHEN again THEN 0.6 ELSE 1 END * CASE WHEN n >= 2 THEN 0.7 ELSE 1 END END, 6) AS score FROM r""",
)
def track_evidence(spark, d):
    """Tracks of each sample, whether none of the last ones is among them, and the score that leaves; two or more
    tracks count as ambiguous here, as samples have three at most."""
    ids = V.faces(spark, d).groupBy("pos").agg(F.sort_array(F.collect_list("track")).alias("ids"))
    s = V.samples(spark, d).join(ids, "pos", "left")
    before = Window.partitionBy("src").orderBy("t", "pos").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("prev", F.last("ids", True).over(before))
    s = s.withColumn("n", F.coalesce(F.size("ids"), F.lit(0)).cast("long")).withColumn("n", F.when(F.col("ids").isNull(), 0).otherwise(F.col("n")))
    again = F.coalesce(F.col("ids").isNotNull() & F.col("prev").isNotNull() & ~F.arrays_overlap("prev", "ids"), F.lit(False))
    found = F.when(F.col("reacquired"), 0.6).otherwise(1.0) * F.when(F.col("n") >= 2, 0.7).otherwise(1.0)
    score = F.when(F.col("n") == 0, F.when(F.col("prev").isNull(), 0.0).otherwise(0.25)).otherwise(found)
    return s.withColumn("reacquired", again).select("pos", F.col("n").cast("long").alias("n"), "reacquired", F.round(score, 6).alias("score"))


@query("mask_propagation")
def mask_propagation(spark, d):
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    e = V.table(spark, d, "embeddings")
    own = F.transform("embedding", lambda v: (v > 0).cast("int"))
    dx = F.transform("embedding", lambda v: F.round((unit(0.5 + v.cast("double") * 2) - 0.5) * 4).cast("int"))
    dy = F.transform("embedding", lambda v: F.round((unit(0.4 - v.cast("double")) - 0.4) * 4).cast("int"))
    return propagate_masks(e.select(F.col("label").cast("long").alias("src"), F.col("vec_id").alias("key"), own.alias("own"), dx.alias("dx"), dy.alias("dy")))

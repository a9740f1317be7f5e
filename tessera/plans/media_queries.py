"""Times, parameters, records, evidence, warnings, signals and checks, each with SQL beside it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import attribution as A
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def r6(c):
    return F.round(c, 6)


# Times.
@query(
    "word_timing",
    """WITH w AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 7 END AS ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 7 + user_id % 50 - 20 END AS te, event_id * 5 AS ss, event_id * 5 + user_id % 90 AS se FROM events),
      c AS (SELECT event_id, coalesce(ts, ss) AS a, coalesce(te, se) AS b FROM w)
      SELECT event_id, a AS start_tick, greatest(a, b) AS end_tick, a + greatest(0, b - a) // 2 AS mid_tick, round((a + greatest(0, b - a) // 2) / 60000::DOUBLE, 6) AS mid_s FROM c""",
)
def word_timing(spark, d):
    """Timeline ticks if a word has them, else the source's; no word ends before it starts."""
    own = F.col("event_id") % 3 != 0
    e = V.table(spark, d, "events").select(
        "event_id",
        F.coalesce(F.when(own, F.col("event_id") * 7), F.col("event_id") * 5).alias("a"),
        F.coalesce(F.when(own, F.col("event_id") * 7 + F.col("user_id") % 50 - 20), F.col("event_id") * 5 + F.col("user_id") % 90).alias("b"),
    )
    mid = F.expr("a + greatest(0, b - a) div 2")
    return e.select("event_id", F.col("a").alias("start_tick"), F.greatest("a", "b").alias("end_tick"), mid.alias("mid_tick"), r6(mid / 60000.0).alias("mid_s"))


_FACTOR = "CASE off % 5 WHEN 0 THEN '1.5' WHEN 1 THEN 'fast' WHEN 2 THEN '-2' WHEN 3 THEN 'Infinity' ELSE '0.25' END"


@query("source_time", V.ctes("clips") + f""", f AS (SELECT *, {_FACTOR} AS given FROM clips), n AS (SELECT *, try_cast(given AS DOUBLE) AS x FROM f)
   SELECT timeline, clip, round(((150000 - "start") / 60000::DOUBLE + off / 100::DOUBLE) * CASE WHEN x IS NOT NULL AND isfinite(x) AND x > 0 THEN x ELSE 1 END, 6) AS source_s FROM n""")
def source_time(spark, d):
    """Where a clip reads its source at tick 150,000; a factor that is no positive finite number is ignored."""
    given = F.element_at(F.array(*[F.lit(x) for x in ("1.5", "fast", "-2", "Infinity", "0.25")]), (F.col("off") % 5 + 1).cast("int"))
    x = given.try_cast("double")
    factor = F.when(x.isNotNull() & (x > 0) & (x < float("inf")), x).otherwise(1.0)
    return V.clips(spark, d).select("timeline", "clip", r6(((F.lit(150000) - F.col("start")) / 60000.0 + F.col("off") / 100.0) * factor).alias("source_s"))


@query("frames_sampled", V.ctes("samples") + """, g AS (SELECT src, max(t) AS last FROM samples GROUP BY src), k AS (SELECT src, unnest(range(0, floor(last / 2.5)::BIGINT + 1)) * 2.5::DOUBLE AS point, last FROM g),
   n AS (SELECT k.src, k.point, (SELECT min(row(s.t, s.pos)) FROM samples s WHERE s.src = k.src AND s.t >= k.point - 1e-4) AS hit FROM k WHERE k.point < last - 1e-4)
   SELECT src, point, hit[2] AS pos FROM n""")
def frames_sampled(spark, d):
    """The first frame at or behind every point of a grid of two and a half seconds."""
    s = V.samples(spark, d)
    last = s.groupBy("src").agg(F.max("t").alias("last"))
    grid = last.select("src", "last", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 2.5)), lambda k: k * F.lit(2.5).cast("double"))).alias("point")).where(F.col("point") < F.col("last") - 1e-4)
    marks = s.select("src", F.col("t").alias("when"), F.struct("t", "pos").alias("frame"), F.lit(None).cast("double").alias("point"))
    both = marks.unionByName(grid.select("src", (F.col("point") - 1e-4).alias("when"), F.lit(None).cast("struct<t: double, pos: bigint>").alias("frame"), "point"))
    # going back in time, a frame comes before a point that it still serves
    back = Window.partitionBy("src").orderBy(F.desc("when"), F.col("point").isNotNull(), F.col("frame.pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("hit", F.last("frame", True).over(back)).where("point is not null").select("src", "point", F.col("hit.pos").alias("pos"))


@query("depth_frames", V.ctes("samples") + " SELECT pos, greatest(0, least(299, floor((t - 1.5) / 0.5)))::BIGINT AS frame FROM samples")
def depth_frames(spark, d):
    """The frame of a depth track of 300 frames, half a second each, from 1.5 s on; outside the first or last one."""
    return V.samples(spark, d).select("pos", F.greatest(F.lit(0), F.least(F.lit(299), F.floor((F.col("t") - 1.5) / 0.5))).cast("long").alias("frame"))


@query("missing_sources", V.ctes("samples") + """ SELECT c.k AS clip, coalesce(avg(s.luma), 0) AS luma, CASE WHEN count(s.pos) = 0 THEN 'missing source ' || c.k::VARCHAR END AS warning
   FROM (SELECT unnest(range(0, 14)) AS k) c LEFT JOIN samples s ON s.src = c.k AND s.t >= 10 AND s.t < 11 GROUP BY c.k""")
def missing_sources(spark, d):
    """Clips whose source gives nothing are black and say so."""
    c = spark.range(14).withColumnRenamed("id", "k")
    got = c.join(V.samples(spark, d).where("t >= 10 and t < 11"), F.col("k") == F.col("src"), "left").groupBy("k").agg(F.avg("luma").alias("luma"), F.count("pos").alias("n"))
    return got.select(F.col("k").alias("clip"), F.coalesce("luma", F.lit(0.0)).alias("luma"), F.when(F.col("n") == 0, F.concat(F.lit("missing source "), F.col("k").cast("string"))).alias("warning"))


# Signals: samples of a source as a signal at so many a second.
RATE = 64
TONES = """WITH g AS (SELECT unnest(range(0, 4096)) AS i), s AS (SELECT i, i / 4096::DOUBLE AS t FROM g)"""


@query("generated_tones", TONES + f""" SELECT kind, i, round(CASE kind WHEN 'sine' THEN 0.1 * sin({2 * math.pi}::DOUBLE * 440 * t) WHEN 'sweep' THEN 0.1 * sin({2 * math.pi}::DOUBLE * (20 * t + (200 - 20) / 2 * t * t))
     WHEN 'impulse' THEN CASE WHEN i % 1024 = 0 THEN 0.9 ELSE 0 END WHEN 'marker' THEN CASE WHEN i = 2048 THEN 0.9 ELSE 0 END END, 9) AS value FROM s, (SELECT unnest(['sine', 'sweep', 'impulse', 'marker']) AS kind) k""")
def generated_tones(spark, d):
    """A second of test signals: tone, sweep from 20 to 200 Hz, impulses every quarter, one mark."""
    t, i = F.col("i") / 4096.0, F.col("i")
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), v.cast("double").alias("value")) for n, v in (
        ("sine", F.sin(t * (2 * math.pi * 440)) * 0.1),
        ("sweep", F.sin((t * 20 + t * t * ((200 - 20) / 2.0)) * (2 * math.pi)) * 0.1),
        ("impulse", F.when(i % 1024 == 0, 0.9).otherwise(0.0)),
        ("marker", F.when(i == 2048, 0.9).otherwise(0.0)),
    )])
    return spark.range(4096).withColumnRenamed("id", "i").select("i", F.inline(kinds)).select("kind", "i", F.round("value", 9).alias("value"))


@query("mono_windows", """WITH e AS (SELECT vec_id, label, embedding AS v FROM embeddings), p AS (SELECT vec_id, k AS i, (v[2 * k + 1]::DOUBLE + v[2 * k + 2]::DOUBLE) / 2 AS x FROM e, (SELECT unnest(range(0, 32)) AS k) n)
   SELECT vec_id, i // 8 AS win, count(*) AS n, round(sqrt(avg(x * x)), 9) AS rms, round(max(abs(x)), 9) AS peak FROM p GROUP BY ALL""")
def mono_windows(spark, d):
    """Two interleaved channels to their mean, in windows of eight samples."""
    e = V.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: (F.get("embedding", k * 2).cast("double") + F.get("embedding", k * 2 + 1).cast("double")) / 2)).alias("i", "x"))
    w = e.groupBy("vec_id", F.floor(F.col("i") / 8).alias("win"))
    return w.agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 9).alias("rms"), F.round(F.max(F.abs("x")), 9).alias("peak"))


WIN, HOP, LEAST = 24, 8, 0.05


@query("embedding_windows", f"""WITH p AS (SELECT vec_id, k AS i, embedding[k + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS k) n), s AS (SELECT unnest(range(0, 64, {HOP})) AS a),
   w AS (SELECT vec_id, a, count(*) AS n, sqrt(avg(x * x)) AS rms, sqrt(sum(power(x * (0.5 - 0.5 * cos({2 * math.pi} * (i - a) / {WIN - 1})), 2))) AS len FROM p JOIN s ON i >= a AND i < a + {WIN} GROUP BY ALL)
   SELECT vec_id, (a + {WIN} * 0.5::DOUBLE) / {RATE} AS mid, round(len, 9) AS length FROM w WHERE n = {WIN} AND rms >= {LEAST}""")
def embedding_windows(spark, d):
    """Full windows that are loud enough, tapered, with the length of what an embedding gets."""
    x = V.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (WIN - 1)) / HOP))
    each = x.select("vec_id", "i", F.col("v").cast("double").alias("x"), F.explode(F.sequence(first, F.floor(F.col("i") / HOP))).alias("k")).withColumn("a", F.col("k") * HOP)
    taper = 0.5 - 0.5 * F.cos((F.col("i") - F.col("a")) * (2 * math.pi) / (WIN - 1))
    w = each.groupBy("vec_id", "a").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.sqrt(F.sum(F.pow(F.col("x") * taper, 2))).alias("len"))
    return w.where((F.col("n") == WIN) & (F.col("rms") >= LEAST)).select("vec_id", ((F.col("a") + WIN * 0.5) / RATE).alias("mid"), F.round("len", 9).alias("length"))


def spectral_features(blocks: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, dominant frequency and flatness of signals (row, sample): mean removed, tapered, transformed."""
    n = blocks.shape[1]
    x = (blocks - blocks.mean(axis=1, keepdims=True)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n))
    size = np.abs(np.fft.fft(x, axis=1))[:, : n // 2]
    size[:, 0] = 0
    hz = rate / 2 / (n // 2)
    m = size[:, 1:] + 1e-12
    silent = m.sum(axis=1) <= 1e-9
    centroid = (m * (np.arange(1, n // 2) * hz)).sum(axis=1) / m.sum(axis=1)
    flat = np.exp(np.log(m).mean(axis=1)) / m.mean(axis=1)
    return np.where(silent, 0, np.round(centroid, 3)), size.argmax(axis=1) * hz, np.where(silent, 1, np.round(flat.clip(0, 1), 6))


_TAP = f"(embedding[k + 1]::DOUBLE - mean) * (0.5 - 0.5 * cos({2 * math.pi} * k / 64))"


@query("spectral_features", f"""WITH e AS (SELECT vec_id, embedding, list_avg(list_transform(embedding, lambda v: v::DOUBLE)) AS mean FROM embeddings), x AS (SELECT vec_id, k, {_TAP} AS v FROM e, (SELECT unnest(range(0, 64)) AS k) n),
   f AS (SELECT vec_id, b, sqrt(power(sum(v * cos({2 * math.pi} * b * k / 64)), 2) + power(sum(v * sin({2 * math.pi} * b * k / 64)), 2)) AS m FROM x, (SELECT unnest(range(1, 32)) AS b) q GROUP BY ALL)
   SELECT vec_id, round(sum((m + 1e-12) * b * 250) / sum(m + 1e-12), 3) AS centroid, max_by(b, round(m, 9)) * 250::DOUBLE AS dominant, round(exp(avg(ln(m + 1e-12))) / avg(m + 1e-12), 6) AS flatness FROM f GROUP BY vec_id""")
def spectral(spark, d):
    def run(batches):
        for b in batches:
            c, top, flat = spectral_features(np.stack(b["embedding"]).astype(float), 16000.0)
            yield pd.DataFrame({"vec_id": b["vec_id"], "centroid": c, "dominant": top, "flatness": flat})

    return V.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, centroid double, dominant double, flatness double")


@query("segment_means", V.ctes("segments") + """, g AS (SELECT src, kind, sum(("end" - "start") * conf) / sum("end" - "start") AS m FROM segments GROUP BY ALL) SELECT src, kind, CASE WHEN isfinite(m) AND abs(m) >= 1e-9 THEN round(m, 9) END AS mean FROM g""")
def segment_means(spark, d):
    """Means weighed by duration; what is as good as zero or not finite is unknown."""
    dur = F.col("end") - F.col("start")
    m = V.segments(spark, d).groupBy("src", "kind").agg(F.try_divide(F.sum(dur * F.col("conf")), F.sum(dur)).alias("m"))
    return m.select("src", "kind", F.when((F.abs("m") >= 1e-9) & (F.abs("m") < float("inf")), F.round("m", 9)).alias("mean"))


_NOISE = """s AS (SELECT seg, src, "start" AS a, "end" AS b, kind, -70 + seg % 60 AS rms, (seg * 37) % 9000 AS hz, (seg % 97) / 97::DOUBLE AS flat FROM segments)"""


@query(
    "audio_warnings",
    V.ctes("segments") + f""", {_NOISE}, g AS (SELECT src, max(b) AS len, max(conf) AS peak FROM (SELECT src, "end" AS b, conf FROM segments) q GROUP BY src),
      w AS (SELECT src, a, b, CASE WHEN b - a >= 1.25 THEN 'red' ELSE 'yellow' END AS severity, 'audio_silence' AS code FROM s WHERE kind = 'silence' AND b - a >= 0.25
        UNION ALL SELECT src, 0, len, 'red', 'audio_clip_risk' FROM g WHERE 20 * log10(peak) > -0.3
        UNION ALL SELECT src, a, b, CASE WHEN hz > CASE kind WHEN 'speechLike' THEN 7000 ELSE 6000 END AND flat > CASE kind WHEN 'speechLike' THEN 0.75 ELSE 0.65 END THEN 'red' ELSE 'yellow' END, 'audio_noise_risk' FROM s
          WHERE kind <> 'silence' AND rms > -45 AND b - a >= 0.75 AND hz > CASE kind WHEN 'speechLike' THEN 5500 ELSE 4800 END AND flat > CASE kind WHEN 'speechLike' THEN 0.65 ELSE 0.5 END)
      SELECT src, round(a, 6) AS start_s, round(b, 6) AS end_s, severity, code FROM w""",
)
def audio_warnings(spark, d):
    """Silences, clipping of a whole source, and noisy segments, which may be noisier while someone speaks."""
    s = V.segments(spark, d).select("src", "conf", F.col("start").alias("a"), F.col("end").alias("b"), "kind", (F.col("seg") % 60 - 70).alias("rms"), (F.col("seg") * 37 % 9000).alias("hz"), (F.col("seg") % 97 / 97.0).alias("flat"))
    dur, speech = F.col("b") - F.col("a"), F.col("kind") == "speechLike"
    by = lambda one, other: F.when(speech, one).otherwise(other)
    row = lambda severity, code: ["src", r6("a").alias("start_s"), r6("b").alias("end_s"), severity.alias("severity"), F.lit(code).alias("code")]
    quiet = s.where((F.col("kind") == "silence") & (dur >= 0.25)).select(*row(F.when(dur >= 1.25, "red").otherwise("yellow"), "audio_silence"))
    loud = s.groupBy("src").agg(F.max("b").alias("b"), F.max("conf").alias("peak")).where(F.log10("peak") * 20 > -0.3).withColumn("a", F.lit(0.0)).select(*row(F.lit("red"), "audio_clip_risk"))
    noisy = s.where((F.col("kind") != "silence") & (F.col("rms") > -45) & (dur >= 0.75) & (F.col("hz") > by(5500, 4800)) & (F.col("flat") > by(0.65, 0.5)))
    severe = (F.col("hz") > by(7000, 6000)) & (F.col("flat") > by(0.75, 0.65))
    return quiet.unionByName(loud).unionByName(noisy.select(*row(F.when(severe, "red").otherwise("yellow"), "audio_noise_risk")))


@query(
    "evidence_windows",
    V.ctes("segments") + """, z AS (SELECT src, max("end") AS len FROM segments GROUP BY src), n AS (SELECT src, seg, ("start" + "end") / 2 AS c, row_number() OVER (PARTITION BY src ORDER BY "start", seg) - 1 AS k, count(*) OVER (PARTITION BY src) AS m FROM segments WHERE kind = 'unknown'),
      pick AS (SELECT src, 'noise_risk' AS label, c FROM n WHERE k = ('0x' || sha256('seed|noise_risk')[:8])::BIGINT % m),
      loud AS (SELECT src, 'clip_risk', arg_min(("start" + "end") / 2, row(-conf, "start", "end", seg)) FROM segments WHERE kind <> 'silence' GROUP BY src),
      talk AS (SELECT src, 'speech_baseline', arg_min(("start" + "end") / 2, row("start", seg)) FROM segments WHERE kind = 'speechLike' GROUP BY src),
      o AS (SELECT *, lag(kind) OVER (PARTITION BY src ORDER BY "start", seg) AS before FROM segments), turn AS (SELECT src, 'silence_to_speech', min("start") FROM o WHERE kind = 'speechLike' AND before = 'silence' GROUP BY src),
      w AS (SELECT * FROM pick UNION ALL SELECT * FROM loud UNION ALL SELECT * FROM talk UNION ALL SELECT * FROM turn), p AS (SELECT src, label, least(greatest(0, c - 2), greatest(0, len - 4)) AS a, len FROM w JOIN z USING (src)),
      e AS (SELECT *, least(len, a + 4) AS b FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY a, b, label) AS r FROM e) SELECT src, r, label, round(a, 6) AS start_s, round(b, 6) AS end_s FROM f WHERE r <= 3""",
)
def evidence_windows(spark, d):
    """Windows of four seconds worth hearing: one noisy segment by a seed, the loudest, the first speech, the first
    speech out of silence; three at most of each source."""
    s = V.segments(spark, d).withColumn("c", (F.col("start") + F.col("end")) / 2)
    by = Window.partitionBy("src")
    noisy = s.where("kind = 'unknown'").withColumns({"k": F.row_number().over(by.orderBy("start", "seg")) - 1, "m": F.count("*").over(by)})
    drawn = F.conv(F.substring(F.sha2(F.lit("seed|noise_risk"), 256), 1, 8), 16, 10).cast("long")
    label = lambda df, name: df.select("src", F.lit(name).alias("label"), "c")
    turn = s.withColumn("before", F.lag("kind").over(by.orderBy("start", "seg"))).where("kind = 'speechLike' and before = 'silence'")
    found = [
        label(noisy.where(F.col("k") == drawn % F.col("m")), "noise_risk"),
        label(s.where("kind <> 'silence'").groupBy("src").agg(F.min_by("c", F.struct(-F.col("conf"), "start", "end", "seg")).alias("c")), "clip_risk"),
        label(s.where("kind = 'speechLike'").groupBy("src").agg(F.min_by("c", F.struct("start", "seg")).alias("c")), "speech_baseline"),
        label(turn.groupBy("src").agg(F.min("start").alias("c")), "silence_to_speech"),
    ]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).join(s.groupBy("src").agg(F.max("end").alias("len")), "src")
    placed = every.withColumn("a", F.least(F.greatest(F.lit(0.0), F.col("c") - 2), F.greatest(F.lit(0.0), F.col("len") - 4))).withColumn("b", F.least("len", F.col("a") + 4))
    ranked = placed.withColumn("r", F.row_number().over(by.orderBy("a", "b", "label")).cast("long")).where("r <= 3")
    return ranked.select("src", "r", "label", r6("a").alias("start_s"), r6("b").alias("end_s"))


@query("warning_union", V.ctes("samples", "segments") + """ SELECT src, round("start", 6) AS start_s, kind AS what FROM segments WHERE kind IN ('silence', 'unknown') UNION ALL SELECT src, round(t, 6), 'dark' FROM samples WHERE luma < 0.02 UNION ALL SELECT src, 0, 'device' FROM samples WHERE pos % 1000 = 1""")
def warning_union(spark, d):
    """Warnings of sound, picture and device together, repeats kept."""
    sound = V.segments(spark, d).where("kind in ('silence', 'unknown')").select("src", r6("start").alias("start_s"), F.col("kind").alias("what"))
    s = V.samples(spark, d)
    dark = s.where("luma < 0.02").select("src", r6("t").alias("start_s"), F.lit("dark").alias("what"))
    return sound.unionByName(dark).unionByName(s.where("pos % 1000 = 1").select("src", F.lit(0.0).alias("start_s"), F.lit("device").alias("what")))


@query("speakers_without", V.ctes("faces") + """ SELECT pos, track, list_sort(list_filter(list_distinct(list(track) OVER (PARTITION BY pos)), lambda x: x <> track)) AS others FROM faces""")
def speakers_without(spark, d):
    """For each face the distinct other tracks of its sample."""
    f = V.faces(spark, d).select("pos", "track")
    every = f.groupBy("pos").agg(F.collect_set("track").alias("every"))
    return f.join(every, "pos").select("pos", "track", F.array_sort(F.array_except("every", F.array("track"))).alias("others"))


# Records.
_SCORE = "luma * 3 - 0.3"
_GRADE = "CASE WHEN s >= 0.95::FLOAT THEN 'VERIFIED' WHEN s >= 0.8::FLOAT THEN 'STRONG' WHEN s >= 0.55::FLOAT THEN 'AMBIGUOUS' WHEN s >= 0.3::FLOAT THEN 'WEAK' ELSE 'INVALID' END"


@query("confidence_records", V.ctes("ev") + f""", c AS (SELECT event_id, event_type, least(1, greatest(0, {_SCORE}))::FLOAT AS s FROM ev)
   SELECT event_id, round(s::DOUBLE, 6) AS score, {_GRADE} AS grade, list_sort(['vision', event_type, 'audio']) AS sources, list_sort(CASE WHEN s < 0.3::FLOAT THEN ['weak', 'low_luma'] ELSE []::VARCHAR[] END) AS reasons, CASE WHEN event_id % 2 = 0 THEN 'policy.v1' END AS policy FROM c""")
def confidence_records(spark, d):
    """A score cut to its range with its grade, its sources and reasons in order, and a policy if it is a decision."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("luma") * 3 - 0.3)).cast("float")
    reasons = F.when(s < F.lit(0.3).cast("float"), F.array(F.lit("low_luma"), F.lit("weak"))).otherwise(F.array().cast("array<string>"))
    return V.timed_events(spark, d).select(
        "event_id", r6(s.cast("double")).alias("score"), A.confidence_grade(s).alias("grade"), F.array_sort(F.array(F.lit("vision"), "event_type", F.lit("audio"))).alias("sources"), F.array_sort(reasons).alias("reasons"), F.when(F.col("event_id") % 2 == 0, "policy.v1").alias("policy")
    )


@query("evidenced_values", V.ctes("samples", "faces") + """, n AS (SELECT p.pos, p.luma, p.skin, count(f.track) AS faces FROM samples p LEFT JOIN faces f USING (pos) GROUP BY ALL)
   SELECT pos, unnest(['video.faces.count', 'video.meanLuma', 'video.skinLikelihood']) AS key, unnest([faces::DOUBLE, round(luma, 9), round(skin, 9)]) AS value, 'deterministic' AS level, unnest(['metric:video.faces.count', 'metric:video.meanLuma', 'metric:video.skinLikelihood']) AS provenance FROM n""")
def evidenced_values(spark, d):
    """Each sample's values with how sure they are and where they come from, by key."""
    n = V.samples(spark, d).join(V.faces(spark, d).groupBy("pos").agg(F.count("*").alias("n")), "pos", "left")
    values = {"video.faces.count": F.coalesce("n", F.lit(0)).cast("double"), "video.meanLuma": F.round("luma", 9), "video.skinLikelihood": F.round("skin", 9)}
    each = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit("deterministic").alias("level"), F.lit("metric:" + k).alias("provenance")) for k, v in sorted(values.items())])
    return n.select("pos", F.inline(each))


@query("semantic_attributes", V.ctes("faces", "words") + """, sp AS (SELECT src, min(word_id) AS w, max(speaker) AS who FROM words WHERE speaker = 'user' GROUP BY src)
   SELECT f.pos, f.track, CASE WHEN f.track = 'T' || (sp.w % 6)::VARCHAR THEN 'speaking' ELSE 'not speaking' END AS state, CASE WHEN f.track = 'T' || (sp.w % 6)::VARCHAR THEN ['personId', 'speakerId', 'state'] ELSE ['personId', 'state'] END AS keys FROM faces f LEFT JOIN sp USING (src)""")
def semantic_attributes(spark, d):
    """Each face with its attributes' keys in order; a face that is bound to no speaker is said not to speak."""
    sp = V.words(spark, d).where("speaker = 'user'").groupBy("src").agg(F.min("word_id").alias("first_word"))
    bound = F.coalesce(F.col("track") == F.concat(F.lit("T"), (F.col("first_word") % 6).cast("string")), F.lit(False))
    keys = F.array_compact(F.array(F.lit("personId"), F.when(bound, "speakerId"), F.lit("state")))
    return V.faces(spark, d).join(sp, "src", "left").select("pos", "track", F.when(bound, "speaking").otherwise("not speaking").alias("state"), keys.alias("keys"))


# Numbers.
@query("rect_quantise", V.ctes("faces") + """, g AS (SELECT pos, track, round(x * 1.3 / 1e-4) * 1e-4 AS x, round((y - 0.1) / 1e-4) * 1e-4 AS y, round(w * 1.7 / 1e-4) * 1e-4 AS w FROM faces), k AS (SELECT pos, track, least(1, greatest(0, x)) AS x, least(1, greatest(0, y)) AS y, w FROM g)
   SELECT pos, track, round(x, 4) AS x, round(y, 4) AS y, round(least(w, 1 - x), 4) AS w FROM k""")
def rect_quantise(spark, d):
    """Places on a grid of a ten-thousandth inside the unit square."""
    snap = lambda c: F.round(c / 1e-4) * 1e-4
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    k = V.faces(spark, d).select("pos", "track", unit(snap(F.col("x") * 1.3)).alias("x"), unit(snap(F.col("y") - 0.1)).alias("y"), snap(F.col("w") * 1.7).alias("w"))
    return k.select("pos", "track", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(F.least(F.col("w"), 1 - F.col("x")), 4).alias("w"))


@query("luma_distance", """WITH b AS (SELECT vec_id, list_transform(embedding, lambda v: floor(127.5 + v::DOUBLE * 127)::INTEGER) AS l FROM embeddings), p AS (SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 0 THEN a.l[:63] ELSE a.l END AS x, b.l AS y FROM b a JOIN b ON b.vec_id = a.vec_id + 1)
   SELECT vec_id, CASE WHEN len(x) <> len(y) THEN 'Infinity'::DOUBLE ELSE round(list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))) / len(x)::DOUBLE, 9) END AS distance FROM p""")
def luma_distance(spark, d):
    """Mean difference of two signatures; of different lengths they are infinitely far."""
    b = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 127 + 127.5).cast("int")).alias("l"))
    p = b.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("l", 1, 63)).otherwise(F.col("l")).alias("x")).join(b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("l").alias("y")), "vec_id")
    far = F.aggregate(F.zip_with("x", "y", lambda a, c: F.abs(a - c)), F.lit(0), lambda s, v: s + v) / F.size("x")
    return p.select("vec_id", F.when(F.size("x") != F.size("y"), float("inf")).otherwise(F.round(far, 9)).alias("distance"))


def hashes(names: list[str]) -> tuple[list[str], np.ndarray]:
    """FNV-1a of the bytes and SplitMix64 of that as a number in [0, 1); constants are fixed values."""
    out = np.full(len(names), 14695981039346656037, np.uint64)
    raw = [x.encode() for x in names]
    with np.errstate(over="ignore"):
        for at in range(max(map(len, raw), default=0)):
            live = np.array([at < len(x) for x in raw])
            byte = np.array([x[at] if at < len(x) else 0 for x in raw], np.uint64)
            out = np.where(live, (out ^ byte) * np.uint64(1099511628211), out)
        z = out + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return [f"{x:016x}" for x in out.tolist()], (z >> np.uint64(40)).astype(float) / (1 << 24)


_M = "18446744073709551616"


@query("stable_hashes", f"""WITH b AS (SELECT c_custkey, c_name, list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT) AS bs FROM customer),
   f AS (SELECT c_custkey, list_reduce(bs, lambda h, x: (xor(h, x) * 1099511628211) % {_M}, 14695981039346656037::HUGEINT) AS h FROM b), z0 AS (SELECT *, (h + 11400714819323198485::HUGEINT) % {_M} AS z FROM f),
   z1 AS (SELECT *, (xor(z, z >> 30)::HUGEINT // 4294967296) AS hi, xor(z, z >> 30) % 4294967296 AS lo FROM z0), y1 AS (SELECT *, (((hi * 13787848793156543929::HUGEINT) % 4294967296) * 4294967296 + lo * 13787848793156543929::HUGEINT) % {_M} AS y FROM z1),
   z2 AS (SELECT *, xor(y, y >> 27) // 4294967296 AS hi2, xor(y, y >> 27) % 4294967296 AS lo2 FROM y1), y2 AS (SELECT *, (((hi2 * 10723151780598845931::HUGEINT) % 4294967296) * 4294967296 + lo2 * 10723151780598845931::HUGEINT) % {_M} AS q FROM z2)
   SELECT c_custkey, printf('%016x', h::UBIGINT) AS fnv, ((xor(q, q >> 31) >> 40) / 16777216::DOUBLE) AS unit FROM y2""")
def stable_hashes(spark, d):
    def run(batches):
        for b in batches:
            fnv, unit = hashes(b["c_name"].tolist())
            yield pd.DataFrame({"c_custkey": b["c_custkey"], "fnv": fnv, "unit": unit})

    return V.table(spark, d, "customer").select("c_custkey", "c_name").mapInPandas(run, "c_custkey long, fnv string, unit double")


@query("histogram_range", V.ctes("pixels") + """, h AS (SELECT frame, least(255, floor((0.2126 * r + 0.7152 * g + 0.0722 * b) * 255 + 0.5))::INTEGER AS bin, count(*) / 64::DOUBLE AS p FROM pixels GROUP BY ALL)
   SELECT frame, round(sum(bin / 255::DOUBLE * p), 9) AS mean, round(coalesce(sum(p) FILTER (bin <= 25), 0), 9) AS low, round(coalesce(sum(p) FILTER (bin >= 230), 0), 9) AS high FROM h GROUP BY frame""")
def histogram_range(spark, d):
    """Mean and the shares of the darkest and brightest bins, from each frame's histogram."""
    luma = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    h = V.pixels(spark, d).groupBy("frame", F.least(F.lit(255), F.floor(luma * 255 + 0.5)).alias("bin")).agg((F.count("*") / 64.0).alias("p"))
    share = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, F.col("p"))), F.lit(0.0)), 9)
    return h.groupBy("frame").agg(F.round(F.sum(F.col("bin") / 255.0 * F.col("p")), 9).alias("mean"), share(F.col("bin") <= 25).alias("low"), share(F.col("bin") >= 230).alias("high"))


@query("stretch_range", V.ctes("pixels") + """, m AS (SELECT frame, min(r) AS lo, max(r) AS hi, count(*) AS n FROM pixels GROUP BY frame), b AS (SELECT p.frame, least(99, floor((p.r - lo) / (hi - lo) * 100))::INTEGER AS bin, count(*) AS k FROM pixels p JOIN m USING (frame) WHERE hi > lo GROUP BY ALL),
   c AS (SELECT *, sum(k) OVER (PARTITION BY frame ORDER BY bin) AS upto FROM b) SELECT frame, round(min(lo + (bin + 0.5) / 100 * (hi - lo)) FILTER (upto >= greatest(1, floor(n * 0.05))), 9) AS black, round(min(lo + (bin + 0.5) / 100 * (hi - lo)) FILTER (upto >= greatest(1, floor(n * 0.95))), 9) AS white FROM c JOIN m USING (frame) GROUP BY frame""")
def stretch_range(spark, d):
    """Black and white points by a histogram of each frame's range: the first bins that reach 5% and 95%."""
    p = V.pixels(spark, d).select("frame", "r")
    m = p.groupBy("frame").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n"))
    at = F.least(F.lit(99), F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100))
    b = p.join(m, "frame").where("hi > lo").groupBy("frame", "lo", "hi", "n", at.alias("bin")).agg(F.count("*").alias("k"))
    c = b.withColumn("upto", F.sum("k").over(Window.partitionBy("frame").orderBy("bin")))
    value = F.col("lo") + (F.col("bin") + 0.5) / 100 * (F.col("hi") - F.col("lo"))
    point = lambda q: F.round(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("n") * q)), value)), 9)
    return c.groupBy("frame").agg(point(0.05).alias("black"), point(0.95).alias("white"))


@query("mask_threshold", V.ctes("pixels") + " SELECT frame, x, y, CASE WHEN r - 0.5 > 0.1 THEN 255 ELSE 0 END AS mask FROM pixels")
def mask_threshold(spark, d):
    return V.pixels(spark, d).select("frame", "x", "y", F.when(F.col("r") - 0.5 > 0.1, 255).otherwise(0).alias("mask"))


@query("mask_from_labels", V.ctes("pixels") + " SELECT frame, x, y, CASE WHEN floor(g * 10) IN (3, 4, 7) THEN 255 ELSE 0 END AS mask FROM pixels")
def mask_from_labels(spark, d):
    return V.pixels(spark, d).select("frame", "x", "y", F.when(F.floor(F.col("g") * 10).isin(3, 4, 7), 255).otherwise(0).alias("mask"))


@query("bounding_rects", V.ctes("faces") + """, b AS (SELECT pos, greatest(0, min(x - 0.05)) AS x0, greatest(0, min(y - 0.05)) AS y0, least(1, max(x + w)) AS x1, least(1, max(y + h)) AS y1 FROM faces GROUP BY pos)
   SELECT pos, round(x0, 9) AS x, round(y0, 9) AS y, round(x1 - x0, 9) AS w, round(y1 - y0, 9) AS h FROM b WHERE x1 - x0 >= 1e-4 AND y1 - y0 >= 1e-4""")
def bounding_rects(spark, d):
    """The box around all faces of a sample inside the unit square; none if it is too thin."""
    zero, one = F.lit(0.0), F.lit(1.0)
    b = V.faces(spark, d).groupBy("pos").agg(F.greatest(zero, F.min(F.col("x") - 0.05)).alias("x0"), F.greatest(zero, F.min(F.col("y") - 0.05)).alias("y0"), F.least(one, F.max(F.col("x") + F.col("w"))).alias("x1"), F.least(one, F.max(F.col("y") + F.col("h"))).alias("y1"))
    return b.where("x1 - x0 >= 1e-4 and y1 - y0 >= 1e-4").select("pos", F.round("x0", 9).alias("x"), F.round("y0", 9).alias("y"), F.round(F.expr("x1 - x0"), 9).alias("w"), F.round(F.expr("y1 - y0"), 9).alias("h"))


@query("reordered_deltas", V.ctes("samples") + """, o AS (SELECT src, pos, t - lag(t) OVER (PARTITION BY src ORDER BY t, pos) AS dt, t < lag(t) OVER (PARTITION BY src ORDER BY pos * 7919 % 10007, pos) AS late FROM samples) SELECT src, count(dt) AS n, round(min(dt), 9) AS least, round(max(dt), 9) AS most, count(*) FILTER (late) AS out_of_order FROM o GROUP BY src""")
def reordered_deltas(spark, d):
    """Frames that arrive out of order put in order before their distances are taken; how many came late."""
    by = Window.partitionBy("src")
    o = V.samples(spark, d).select("src", (F.col("t") - F.lag("t").over(by.orderBy("t", "pos"))).alias("dt"), (F.col("t") < F.lag("t").over(by.orderBy(F.col("pos") * 7919 % 10007, "pos"))).alias("late"))
    return o.groupBy("src").agg(F.count("dt").alias("n"), F.round(F.min("dt"), 9).alias("least"), F.round(F.max("dt"), 9).alias("most"), F.count_if("late").alias("out_of_order"))


# Texts.
@query("accepted_flags", r"""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Sure: {"accepted": true, "why": "ok"} done' WHEN 1 THEN 'no json here' WHEN 2 THEN '{"accepted": false}' WHEN 3 THEN '{"accepted": "yes"}' WHEN 4 THEN '} {' ELSE '{"other": {"accepted": true}}' END AS text FROM events),
   j AS (SELECT event_id, regexp_extract(text, '\{.*\}', 0, 's') AS js FROM t) SELECT event_id, CASE WHEN js <> '' AND json_valid(js) AND json_type(js, '$.accepted') = 'BOOLEAN' THEN (js ->> '$.accepted')::BOOLEAN END AS accepted FROM j""")
def accepted_flags(spark, d):
    """The flag of the JSON between the first and the last brace; null if there is none."""
    texts = ('Sure: {"accepted": true, "why": "ok"} done', "no json here", '{"accepted": false}', '{"accepted": "yes"}', "} {", '{"other": {"accepted": true}}')
    text = F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("event_id") % 6 + 1).cast("int"))
    found = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "accepted boolean")
    return V.table(spark, d, "events").select("event_id", found["accepted"].alias("accepted"))


@query("intent_validation", """WITH i AS (SELECT event_id, event_type AS action, CASE event_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE ELSE value END AS p FROM events) SELECT event_id, CASE WHEN action = 'error' THEN 'unknown action' WHEN NOT isfinite(p) THEN 'parameter not finite' END AS fault FROM i""")
def intent_validation(spark, d):
    """An unknown action, or a parameter that isn't finite."""
    p = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("inf")).otherwise(F.col("value"))
    fault = F.when(F.col("event_type") == "error", "unknown action").when(F.isnan(p) | (F.abs(p) == float("inf")), "parameter not finite")
    return V.table(spark, d, "events").select("event_id", fault.alias("fault"))


# Timelines and checks.
@query("clip_summary", V.ctes("clips") + """ SELECT timeline, row_number() OVER (PARTITION BY timeline ORDER BY kind, "start", clip) AS n, kind, clip, round("start" / 60000::DOUBLE, 6) AS start_s, round(dur / 60000::DOUBLE, 6) AS duration_s FROM clips""")
def clip_summary(spark, d):
    """The clips of a nested timeline as rows in a fixed order."""
    nested = V.clips(spark, d).groupBy("timeline", "track", "kind").agg(F.collect_list(F.struct("clip", "start", "dur")).alias("clips")).groupBy("timeline").agg(F.collect_list(F.struct("kind", "clips")).alias("tracks"))
    flat = nested.select("timeline", F.explode("tracks").alias("track")).select("timeline", "track.kind", F.explode("track.clips").alias("c")).select("timeline", "kind", "c.*")
    n = F.row_number().over(Window.partitionBy("timeline").orderBy("kind", "start", "clip")).cast("long")
    return flat.select("timeline", n.alias("n"), "kind", "clip", r6(F.col("start") / 60000.0).alias("start_s"), r6(F.col("dur") / 60000.0).alias("duration_s"))


FEATURES = [(0, "video", "clip"), (1, "video", "clip"), (2, "audio", "clip"), (3, "video", "scene"), (4, "video", "clip"), (5, "intrinsic", "clip"), (6, "audio", "clip")]


@query("feature_domains", V.ctes("clips") + f""", f(id, domain, scope) AS (VALUES {', '.join(map(str, FEATURES))}) SELECT timeline, clip, off AS feature, CASE WHEN f.id IS NULL THEN 'unknown' WHEN domain <> 'video' THEN 'skipped' WHEN scope <> 'clip' THEN 'wrong scope' ELSE 'compiled' END AS outcome FROM clips LEFT JOIN f ON f.id = off""")
def feature_domains(spark, d):
    """What becomes of each clip's effect: compiled, skipped, or one of two errors."""
    f = F.broadcast(spark.createDataFrame(FEATURES, "id long, domain string, scope string"))
    outcome = F.when(F.col("id").isNull(), "unknown").when(F.col("domain") != "video", "skipped").when(F.col("scope") != "clip", "wrong scope").otherwise("compiled")
    return V.clips(spark, d).join(f, F.col("id") == F.col("off"), "left").select("timeline", "clip", F.col("off").alias("feature"), outcome.alias("outcome"))


PLANS = [("BUILDING", 720, True), ("AUTOMOBILE", 1080, True), ("MACHINERY", 2160, False), ("HOUSEHOLD", 1080, False), ("FURNITURE", 4320, False)]


@query("export_entitlement", f"""WITH p(seg, height, mark) AS (VALUES {', '.join(f"('{a}', {b}, {str(c).upper()})" for a, b, c in PLANS)}), e AS (SELECT c_custkey, 480 + (c_custkey % 10) * 240 AS asked, c_custkey % 3 <> 0 AS spec, height, mark, 1080 + (c_custkey % 4) * 1080 AS license FROM customer JOIN p ON seg = c_mktsegment)
   SELECT c_custkey, CASE WHEN mark AND NOT spec THEN 'watermark missing' WHEN asked > least(height, license) THEN 'too high' END AS refusal FROM e""")
def export_entitlement(spark, d):
    """Exports that lack a watermark that is due, or are higher than plan and license allow."""
    p = F.broadcast(spark.createDataFrame(PLANS, "seg string, height int, mark boolean"))
    k = F.col("c_custkey")
    refusal = F.when(F.col("mark") & (k % 3 == 0), "watermark missing").when(480 + k % 10 * 240 > F.least(F.col("height"), 1080 + k % 4 * 1080), "too high")
    return V.table(spark, d, "customer").join(p, F.col("seg") == F.col("c_mktsegment")).select("c_custkey", refusal.alias("refusal"))


@query("metadata_checks", """WITH m AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'avc1' WHEN 1 THEN 'hvc1' WHEN 2 THEN 'apcn' END AS codec, CASE p_partkey % 5 WHEN 0 THEN 'SMPTE_ST_2084_PQ' WHEN 1 THEN 'ITU_R_2100_HLG' WHEN 2 THEN 'ITU_R_709_2' WHEN 3 THEN 'sRGB' END AS transfer, 8 + 2 * (p_size % 2) AS depth FROM part),
   h AS (SELECT *, CASE WHEN transfer IS NOT NULL THEN contains(lower(transfer), '2100') OR contains(lower(transfer), 'pq') OR contains(lower(transfer), 'hlg') END AS hdr FROM m)
   SELECT p_partkey, hdr, CASE WHEN codec IS NULL THEN 'no codec' WHEN hdr AND depth < 10 THEN 'depth' WHEN codec = 'avc1' AND hdr THEN 'codec' END AS fault FROM h""")
def metadata_checks(spark, d):
    """Whether a movie's transfer says HDR (null if it has none), and the first rule on its metadata that it breaks."""
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    m = V.table(spark, d, "part").select("p_partkey", pick(("avc1", "hvc1", "apcn", None), F.col("p_size") % 4).alias("codec"), pick(("SMPTE_ST_2084_PQ", "ITU_R_2100_HLG", "ITU_R_709_2", "sRGB", None), F.col("p_partkey") % 5).alias("transfer"), (8 + 2 * (F.col("p_size") % 2)).alias("depth"))
    m = m.withColumn("hdr", F.lower("transfer").rlike("2100|pq|hlg"))
    hdr = F.coalesce("hdr", F.lit(False))
    return m.select("p_partkey", "hdr", F.when(F.col("codec").isNull(), "no codec").when(hdr & (F.col("depth") < 10), "depth").when((F.col("codec") == "avc1") & hdr, "codec").alias("fault"))


@query("quality_report", V.ctes("pixels") + """, m AS (SELECT frame, avg(0.2126 * r + 0.7152 * g + 0.0722 * b) AS luma, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pixels GROUP BY frame),
   l AS (SELECT *, sqrt(power(r - lag(r) OVER w, 2) + power(g - lag(g) OVER w, 2) + power(b - lag(b) OVER w, 2)) AS far FROM m WINDOW w AS (ORDER BY frame)) SELECT frame, round(luma, 9) AS luma, round(far, 9) AS distance FROM l""")
def quality_report(spark, d):
    """Each frame's luma and its distance to the frame before, by number."""
    m = V.pixels(spark, d).groupBy("frame").agg(F.avg(0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")).alias("luma"), *[F.avg(c).alias(c) for c in "rgb"])
    # numbers may have gaps, so the frame before is looked for among hundreds of neighbours and mended at their edges
    block = F.floor(F.col("frame") / 1024)
    last = m.groupBy(block.alias("block")).agg(F.max_by(F.struct("frame", *"rgb"), "frame").alias("end"))
    ends = last.withColumn("before", F.lag("end").over(Window.orderBy("block")))
    inside = Window.partitionBy("block").orderBy("frame")
    q = m.withColumn("block", block).join(ends.select("block", "before"), "block").withColumn("p", F.coalesce(F.lag(F.struct("frame", *"rgb")).over(inside), "before"))
    far = F.sqrt(sum((F.pow(F.col(c) - F.col("p." + c), 2) for c in "rgb"), F.lit(0.0)))
    return q.select("frame", F.round("luma", 9).alias("luma"), F.round(far, 9).alias("distance"))


@query("rate_trace", V.ctes("samples") + """, x AS (SELECT src, t - lag(t) OVER (PARTITION BY src ORDER BY t, pos) AS dt FROM samples), s AS (SELECT src, avg(dt) AS mean, stddev_pop(dt) AS dev FROM x GROUP BY src), c AS (SELECT DISTINCT l_suppkey % 12 AS file FROM lineitem)
   SELECT file, CASE WHEN s.src IS NULL THEN 'unreadable' WHEN dev / mean > 0.5 THEN 'variable' ELSE 'constant' END AS decision FROM c LEFT JOIN s ON s.src = file""")
def rate_trace(spark, d):
    """Every distinct file of the timelines with the decision on its frame rate."""
    dt = F.col("t") - F.lag("t").over(Window.partitionBy("src").orderBy("t", "pos"))
    s = V.samples(spark, d).select("src", dt.alias("dt")).groupBy("src").agg(F.avg("dt").alias("mean"), F.stddev_pop("dt").alias("dev"))
    files = V.table(spark, d, "lineitem").select((F.col("l_suppkey") % 12).alias("file")).distinct()
    decision = F.when(F.col("src").isNull(), "unreadable").when(F.col("dev") / F.col("mean") > 0.5, "variable").otherwise("constant")
    return files.join(s, F.col("src") == F.col("file"), "left").select("file", decision.alias("decision"))


@query("dispatched_edits", V.ctes("clips") + """ SELECT timeline, clip, CASE WHEN off = 3 THEN 'renamed ' || clip ELSE clip END AS name, "start" FROM clips WHERE off <> 7 UNION ALL SELECT DISTINCT timeline, 'added-' || timeline::VARCHAR, 'added-' || timeline::VARCHAR, 0 FROM clips WHERE timeline % 5 = 0""")
def dispatched_edits(spark, d):
    """Clips removed, renamed and added; the table before stays what it was."""
    c = V.clips(spark, d)
    gone = c.where("off = 7").select("timeline", "clip")
    kept = c.join(gone, ["timeline", "clip"], "left_anti").select("timeline", "clip", F.when(F.col("off") == 3, F.concat(F.lit("renamed "), "clip")).otherwise(F.col("clip")).alias("name"), "start")
    name = F.concat(F.lit("added-"), F.col("timeline").cast("string"))
    new = c.where("timeline % 5 = 0").select("timeline").distinct().select("timeline", name.alias("clip"), name.alias("name"), F.lit(0).cast("long").alias("start"))
    return kept.unionByName(new)


@query("edit_targets", V.ctes("clips") + """, o AS (SELECT DISTINCT timeline FROM clips), first AS (SELECT timeline, arg_min(clip, row("start", clip)) AS clip FROM clips WHERE kind = 'video' GROUP BY timeline), asked AS (SELECT timeline, max(clip) AS clip FROM clips WHERE timeline % 3 = 0 GROUP BY timeline)
   SELECT o.timeline, coalesce(asked.clip, first.clip) AS target FROM o LEFT JOIN asked USING (timeline) LEFT JOIN first USING (timeline)""")
def edit_targets(spark, d):
    """The clip that an edit names, else the first video clip; null if there is neither."""
    c = V.clips(spark, d)
    asked = F.max(F.when(F.col("timeline") % 3 == 0, F.col("clip")))
    first = F.min_by(F.when(F.col("kind") == "video", F.col("clip")), F.when(F.col("kind") == "video", F.struct("start", "clip")))
    return c.groupBy("timeline").agg(F.coalesce(asked, first).alias("target"))


POLICIES = [("draft", 0.0, 2), ("review", 0.4, 1), ("master", 0.45, 0), ("review", 0.42, 1)]


@query("policy_library", V.ctes("pixels") + f""", p(n, name, least, allowed) AS (VALUES {', '.join(f"({n}, '{a}', {b}, {c})" for n, (a, b, c) in enumerate(POLICIES))}), l AS (SELECT name, arg_max(least, n) AS least, arg_max(allowed, n) AS allowed FROM p WHERE name <> 'draft' GROUP BY name), m AS (SELECT frame, avg(0.2126 * r + 0.7152 * g + 0.0722 * b) AS luma, max(abs(r - b)) AS tilt FROM pixels GROUP BY frame)
   SELECT frame, name, (luma < least)::INTEGER + (tilt > 0.8)::INTEGER <= allowed AS passes FROM m, l""")
def policy_library(spark, d):
    """Every frame under every policy: a later policy of one name takes the place of the earlier, a removed one doesn't count."""
    listed = spark.createDataFrame([(n, *p) for n, p in enumerate(POLICIES)], "n int, name string, least double, allowed int").where("name <> 'draft'")
    library = listed.groupBy("name").agg(F.max_by(F.struct("least", "allowed"), "n").alias("p")).select("name", "p.*")
    luma = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    m = V.pixels(spark, d).groupBy("frame").agg(F.avg(luma).alias("luma"), F.max(F.abs(F.col("r") - F.col("b"))).alias("tilt"))
    broken = (F.col("luma") < F.col("least")).cast("int") + (F.col("tilt") > 0.8).cast("int")
    return m.join(F.broadcast(library)).select("frame", "name", (broken <= F.col("allowed")).alias("passes"))


CYCLES = 4


@query("feedback_loop", V.ctes("samples") + f""", f AS (SELECT src, avg(luma) AS m FROM samples GROUP BY src), RECURSIVE_STEP AS (SELECT 1)
   SELECT src, n AS cycles, round(g, 9) AS gain, abs(m * g - 0.45) <= 0.02 AS accepted FROM (WITH RECURSIVE r AS (SELECT src, m, 1::DOUBLE AS g, 0 AS n FROM f UNION ALL
     SELECT src, m, least(4, greatest(0.25, g + least(CASE WHEN n = 1 THEN 0.8 ELSE 0.4 END, greatest(CASE WHEN n = 1 THEN -0.8 ELSE -0.4 END, 0.45 / m - g)))), n + 1 FROM r WHERE abs(m * g - 0.45) > 0.02 AND n < {CYCLES}) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC) = 1) q""".replace(", RECURSIVE_STEP AS (SELECT 1)", ""))
def feedback_loop(spark, d):
    """A gain proposed, checked and changed again by bounded steps, with one larger step, until luma is near its aim."""
    q = V.samples(spark, d).groupBy("src").agg(F.avg("luma").alias("m")).withColumns({"g": F.lit(1.0), "n": F.lit(0)})
    for cycle in range(CYCLES):
        most = 0.8 if cycle == 1 else 0.4
        off = F.abs(F.col("m") * F.col("g") - 0.45) > 0.02
        change = F.least(F.lit(most), F.greatest(F.lit(-most), F.lit(0.45) / F.col("m") - F.col("g")))
        q = q.withColumn("open", off).withColumns({"g": F.when(F.col("open"), F.least(F.lit(4.0), F.greatest(F.lit(0.25), F.col("g") + change))).otherwise(F.col("g")), "n": F.when(F.col("open"), F.col("n") + 1).otherwise(F.col("n"))})
    return q.select("src", F.col("n").alias("cycles"), F.round("g", 9).alias("gain"), (F.abs(F.col("m") * F.col("g") - 0.45) <= 0.02).alias("accepted"))

"""Aggregations: sensor and scene statistics, speakers, histograms, signals, timelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import attribution as A
from tessera.operators import temporal as T
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def r6(c):
    return F.round(c, 6)


SCORE_SQL = "w * h + 0.05 * greatest(0, 1 - sqrt(power(x + w / 2 - 0.5, 2) + power(y + h / 2 - 0.5, 2)) / 0.7071)"
NEAR_SQL = """near AS (SELECT * FROM (SELECT w.word_id, w.src, w.t, w.speaker, s.pos, row_number() OVER (PARTITION BY w.word_id ORDER BY abs(s.t - w.t), s.pos) AS n
    FROM words w JOIN samples s ON s.src = w.src AND abs(s.t - w.t) <= 0.5) q WHERE n = 1)"""
REACH_SQL = """tol AS (SELECT src, greatest(0.12, greatest(0.01, (max(t) - min(t)) / greatest(1, count(*) - 1)) / 2 + 0.02) AS tol FROM samples GROUP BY src),
    within AS (SELECT * FROM (SELECT w.word_id, w.src, w.t, s.pos, row_number() OVER (PARTITION BY w.word_id ORDER BY abs(s.t - w.t), s.pos) AS n
      FROM words w LEFT JOIN tol USING (src) LEFT JOIN samples s ON s.src = w.src AND abs(s.t - w.t) <= tol.tol) q WHERE n = 1)"""
ATTR_SQL = f"""{REACH_SQL}, best AS (SELECT pos, track FROM (SELECT pos, track, row_number() OVER (PARTITION BY pos ORDER BY {SCORE_SQL} DESC, track) AS k FROM faces) z WHERE k = 1),
    attr AS (SELECT n.word_id, n.src, n.t, coalesce(best.track, 'OFFSCREEN') AS track FROM within n LEFT JOIN best USING (pos))"""


@query(
    "speaker_attribution",
    V.ctes("words", "samples", "faces", "segments") + "," + ATTR_SQL
    + """, gated AS (SELECT a.* FROM attr a WHERE EXISTS (SELECT 1 FROM segments s WHERE s.src = a.src AND s.kind = 'speechLike' AND a.t >= s."start" AND a.t < s."end")),
    f AS (SELECT src, track, min(t) AS first_t, count(*) AS n FROM gated GROUP BY src, track),
    l AS (SELECT *, CASE WHEN track = 'OFFSCREEN' THEN track ELSE 'T' || (row_number() OVER (PARTITION BY src, track = 'OFFSCREEN' ORDER BY first_t, track))::VARCHAR END AS label FROM f)
    SELECT src, track, label, round(first_t, 6) AS first_t, n FROM l""",
)
def speaker_attribution(spark, d):
    """Words inside speech, each given to the best face near it; speakers by first appearance."""
    gates = V.segments(spark, d).where("kind = 'speechLike'").select("src", "start", "end")
    # segments of a source don't overlap, so a word is in one of them at most
    heard = T.interval_join(V.words(spark, d), gates, by="src", t="t").select("word_id", "src", "t")
    said = A.attribute_words(heard, V.samples(spark, d), V.faces(spark, d))
    return A.labelled_speakers(said).select("src", "track", "label", r6("first_t").alias("first_t"), "n")


@query(
    "sensor_stats",
    V.ctes("samples", "faces", "segments")
    + """, n AS (SELECT p.pos, p.src, count(f.track) AS k, max(f.w * f.h) AS area FROM samples p LEFT JOIN faces f USING (pos) GROUP BY p.pos, p.src),
    a AS (SELECT src, avg((k > 0)::INT) AS presence, avg((k = 1)::INT) AS single, avg((k >= 2)::INT) AS several, avg(coalesce(area, 0)) AS area FROM n GROUP BY src),
    s AS (SELECT src, sum("end" - "start") FILTER (kind = 'speechLike') AS speech, sum("end" - "start") FILTER (kind = 'silence') AS quiet, max("end" - "start") FILTER (kind = 'silence') AS longest FROM segments GROUP BY src)
    SELECT src, round(presence, 6) AS presence, round(single, 6) AS single, round(several, 6) AS several, round(area, 6) AS area, round(coalesce(speech, 0), 6) AS speech_s, round(coalesce(quiet, 0), 6) AS silence_s,
      round(coalesce(longest, 0), 6) AS longest_silence_s FROM a LEFT JOIN s USING (src)""",
)
def sensor_stats(spark, d):
    per = V.faces(spark, d).groupBy("pos").agg(F.count("*").alias("k"), F.max(F.col("w") * F.col("h")).alias("area"))
    n = V.samples(spark, d).join(per, "pos", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    a = n.groupBy("src").agg(*[r6(F.avg(c.cast("int"))).alias(x) for x, c in (("presence", F.col("k") > 0), ("single", F.col("k") == 1), ("several", F.col("k") >= 2))], r6(F.avg(F.coalesce("area", F.lit(0.0)))).alias("area"))
    dur = F.col("end") - F.col("start")
    of = lambda kind: F.when(F.col("kind") == kind, dur)
    s = V.segments(spark, d).groupBy("src").agg(F.sum(of("speechLike")).alias("x"), F.sum(of("silence")).alias("y"), F.max(of("silence")).alias("z"))
    zero = F.lit(0.0)
    return a.join(s, "src", "left").select("src", "presence", "single", "several", "area", r6(F.coalesce("x", zero)).alias("speech_s"), r6(F.coalesce("y", zero)).alias("silence_s"), r6(F.coalesce("z", zero)).alias("longest_silence_s"))


@query(
    "face_window_stats",
    V.ctes("faces", "segments", shared=True)
    + """ SELECT seg, count(*) AS n, round(avg(w * h), 9) AS area, round(sqrt(avg(power(x + w / 2 - 0.5, 2) + power(y + h / 2 - 0.5, 2))), 9) AS centre_rms,
    round(CASE WHEN count(*) >= 2 THEN stddev_pop(w * h) / avg(w * h) END, 9) AS area_cv
    FROM segments s JOIN faces f ON f.src = s.src AND f.t >= s."start" AND f.t < s."end" GROUP BY seg""",
)
def face_window_stats(spark, d):
    met = T.interval_join(V.faces(spark, d, shared=True), V.segments(spark, d, shared=True), by="src", t="t", width=None).withColumn("area", F.col("w") * F.col("h"))
    off = F.pow(F.col("x") + F.col("w") / 2 - 0.5, 2) + F.pow(F.col("y") + F.col("h") / 2 - 0.5, 2)
    return met.groupBy("seg").agg(
        F.count("*").alias("n"), F.round(F.avg("area"), 9).alias("a"), F.round(F.sqrt(F.avg(off)), 9).alias("centre_rms"), F.round(F.when(F.count("*") >= 2, F.stddev_pop("area") / F.avg("area")), 9).alias("area_cv")
    ).withColumnRenamed("a", "area")


@query(
    "scene_context",
    V.ctes("samples")
    + """, m AS (SELECT src, avg(luma) AS luma, avg(skin) AS skin, avg((luma > 0.15)::INT) AS bright FROM samples GROUP BY src)
    SELECT src, CASE WHEN bright > 0.25 THEN 'outdoor' WHEN luma < 0.08 THEN 'indoor' ELSE 'unknown' END AS setting,
      round((CASE WHEN bright > 0.25 THEN 0.7 WHEN luma < 0.08 THEN 0.6 ELSE 0.3 END) - CASE WHEN skin < 0.02 THEN 0.1 ELSE 0 END, 6) AS conf FROM m""",
)
def scene_context(spark, d):
    m = V.samples(spark, d).groupBy("src").agg(F.avg("luma").alias("luma"), F.avg("skin").alias("skin"), F.avg((F.col("luma") > 0.15).cast("int")).alias("bright"))
    out, dark = F.col("bright") > 0.25, F.col("luma") < 0.08
    conf = F.when(out, 0.7).when(dark, 0.6).otherwise(0.3) - F.when(F.col("skin") < 0.02, 0.1).otherwise(0)
    return m.select("src", F.when(out, "outdoor").when(dark, "indoor").otherwise("unknown").alias("setting"), r6(conf).alias("conf"))


@query(
    "speaker_lifecycle",
    V.ctes("words")
    + """ SELECT src, speaker, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, round(avg(luma), 6) AS conf, count(*) * 0.3 >= 2 AND speaker <> 'OFFSCREEN' AS frozen, min_by(word_id, row(t, word_id)) AS first_word
    FROM words WHERE speaker IS NOT NULL GROUP BY src, speaker""",
)
def speaker_lifecycle(spark, d):
    w = V.words(spark, d).where("speaker is not null")
    return w.groupBy("src", "speaker").agg(
        r6(F.min("t")).alias("first_t"), r6(F.max("t")).alias("last_t"), r6(F.avg("luma")).alias("conf"), F.count("*").alias("n"), F.min_by("word_id", F.struct("t", "word_id")).alias("first_word")
    ).withColumn("frozen", (F.col("n") * 0.3 >= 2) & (F.col("speaker") != "OFFSCREEN")).drop("n")


WEIGHT_SQL = NEAR_SQL + """, seen AS (SELECT n.word_id, n.src, n.speaker, f.track, f.w * f.h * (1 + 0.2 * greatest(0, 1 - sqrt(power(x + w / 2 - 0.5, 2) + power(y + h / 2 - 0.5, 2)) / 0.7071)) * (1 + mouth) AS score
    FROM near n JOIN faces f USING (pos) WHERE n.speaker IS NOT NULL),
  sp AS (SELECT *, sum(score) OVER (PARTITION BY word_id) AS total, max(score) OVER (PARTITION BY word_id) AS top FROM seen),
  wt AS (SELECT src, speaker, track, sum(top / total * score / total) AS weight FROM sp GROUP BY src, speaker, track)"""


@query("binding_weights", V.ctes("words", "samples", "faces") + "," + WEIGHT_SQL + " SELECT src, speaker, track, round(weight, 6) AS weight FROM wt")
def binding_weights(spark, d):
    return A.binding_weights(V.words(spark, d), V.samples(spark, d), V.faces(spark, d)).select("src", "speaker", "track", r6("weight").alias("weight"))


POST_SQL = WEIGHT_SQL + """, sh AS (SELECT *, weight / sum(weight) OVER (PARTITION BY src, speaker) AS share, weight / sum(weight) OVER (PARTITION BY src, track) AS g FROM wt),
  asc_ AS (SELECT *, power(share * g * g, 1.2) AS assoc FROM sh), po AS (SELECT src, speaker, track, assoc / sum(assoc) OVER (PARTITION BY src, speaker) AS posterior FROM asc_),
  rk AS (SELECT *, row_number() OVER (PARTITION BY src, speaker ORDER BY round(posterior, 9) DESC, track) AS n, max(posterior) OVER (PARTITION BY src, speaker) AS top FROM po),
  sec AS (SELECT *, max(posterior) FILTER (n = 2) OVER (PARTITION BY src, speaker) AS second FROM rk)"""


@query("posteriors", V.ctes("words", "samples", "faces") + "," + POST_SQL + " SELECT src, speaker, track, round(posterior, 6) AS posterior, top - coalesce(second, 0) < 0.15 AS ambiguous FROM sec WHERE posterior >= 0.2")
def posteriors(spark, d):
    return A.posteriors(A.binding_weights(V.words(spark, d), V.samples(spark, d), V.faces(spark, d))).withColumn("posterior", r6("posterior"))


@query("best_bindings", V.ctes("words", "samples", "faces") + "," + POST_SQL + " SELECT src, speaker, track, round(posterior, 6) AS posterior FROM sec WHERE n = 1 AND posterior >= 0.2")
def best_bindings(spark, d):
    edges = A.posteriors(A.binding_weights(V.words(spark, d), V.samples(spark, d), V.faces(spark, d)))
    w = Window.partitionBy("src", "speaker").orderBy(F.round("posterior", 9).desc(), "track")
    return edges.withColumn("n", F.row_number().over(w)).where("n = 1").select("src", "speaker", "track", r6("posterior").alias("posterior"))


@query(
    "co_speakers",
    V.ctes("words", "samples", "faces") + "," + POST_SQL
    + """, b AS (SELECT src, speaker, track FROM sec WHERE n = 1 AND posterior >= 0.2) SELECT x.src, x.speaker, y.speaker AS other FROM b x JOIN b y ON x.src = y.src AND x.track = y.track AND x.speaker <> y.speaker""",
)
def co_speakers(spark, d):
    """Speakers whose best track is the same."""
    b = best_bindings(spark, d).select("src", "speaker", "track")
    b = b.withColumn("others", F.collect_set("speaker").over(Window.partitionBy("src", "track")))
    return b.select("src", "speaker", F.explode(F.array_remove(F.col("others"), F.col("speaker"))).alias("other"))


@query("track_medians", V.ctes("faces") + " SELECT src, track, round(median(least(1, greatest(0, mouth))), 6) AS mouth, count(*) AS n FROM faces GROUP BY src, track")
def track_medians(spark, d):
    return V.faces(spark, d).groupBy("src", "track").agg(r6(F.median(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mouth"))))).alias("m"), F.count("*").alias("n")).withColumnRenamed("m", "mouth")


@query(
    "person_votes",
    V.ctes("faces")
    + """, v AS (SELECT src, pos, track, row_number() OVER (PARTITION BY pos ORDER BY mouth DESC, track) AS n FROM faces), c AS (SELECT src, track, count(*) FILTER (n = 1) AS votes FROM v GROUP BY src, track),
    p AS (SELECT src, track, count(*) AS presence, sum(w * h) AS area FROM faces GROUP BY src, track)
    SELECT src, track, votes, presence FROM (SELECT p.src, p.track, votes, presence, row_number() OVER (PARTITION BY p.src ORDER BY CASE WHEN votes >= 2 THEN votes ELSE 0 END DESC, presence DESC, round(area, 9) DESC, p.track) AS k FROM p JOIN c USING (src, track)) q WHERE k = 1""",
)
def person_votes(spark, d):
    f = V.faces(spark, d)
    v = f.withColumn("n", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("mouth"), "track")))
    p = v.groupBy("src", "track").agg(F.count_if(F.col("n") == 1).alias("votes"), F.count("*").alias("presence"), F.sum(F.col("w") * F.col("h")).alias("area"))
    k = Window.partitionBy("src").orderBy(F.when(F.col("votes") >= 2, F.col("votes")).otherwise(0).desc(), F.desc("presence"), F.round("area", 9).desc(), "track")
    return p.withColumn("k", F.row_number().over(k)).where("k = 1").select("src", "track", "votes", "presence")


@query(
    "noise_floor",
    V.ctes("samples")
    + """, s AS (SELECT src, list_sort(list(20 * log10(greatest(luma, 1e-5)))) AS db FROM samples GROUP BY src)
    SELECT src, round(least(-45, greatest(-70, db[least(len(db) - 1, floor(0.15 * len(db))::BIGINT) + 1] + 8)), 6) AS floor_db FROM s""",
)
def noise_floor(spark, d):
    """The sample at rank floor(0.15 n) plus 8 dB. Counts by hundredths of a dB tell in which the rank lies,
    so only that one's samples are put in order."""
    s = V.samples(spark, d).withColumn("db", 20 * F.log10(F.greatest(F.col("luma"), F.lit(1e-5)))).withColumn("bin", F.floor(F.col("db") * 100))
    counts, by = s.groupBy("src", "bin").agg(F.count("*").alias("here")), Window.partitionBy("src")
    upto = counts.withColumn("upto", F.sum("here").over(by.orderBy("bin"))).withColumn("n", F.sum("here").over(by))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.15)) + 1
    found = upto.where((F.col("upto") >= at) & (F.col("upto") - F.col("here") < at)).select("src", "bin", (at - F.col("upto") + F.col("here")).alias("at"))
    ranked = s.join(found, ["src", "bin"]).withColumn("rank", F.row_number().over(by.orderBy("db")))
    return ranked.where("rank = at").select("src", r6(F.least(F.lit(-45.0), F.greatest(F.lit(-70.0), F.col("db") + 8))).alias("floor_db"))


def luma():
    return 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")


LUMA_SQL = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


@query("luma_histogram", V.ctes("pixels") + f" SELECT least(255, floor({LUMA_SQL} * 255 + 0.5))::INTEGER AS bin, count(*) AS n FROM pixels GROUP BY 1")
def luma_histogram(spark, d):
    return V.pixels(spark, d).groupBy(F.least(F.lit(255), F.floor(luma() * 255 + 0.5)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "dominant_colours",
    V.ctes("pixels")
    + """, c AS (SELECT frame, (least(15, floor(r * 16)) * 256 + least(15, floor(g * 16)) * 16 + least(15, floor(b * 16)))::INTEGER AS bin, count(*) AS n FROM pixels GROUP BY 1, 2)
    SELECT frame, k, bin, n FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, bin) AS k FROM c) q WHERE k <= 3""",
)
def dominant_colours(spark, d):
    b = lambda c: F.least(F.lit(15), F.floor(F.col(c) * 16))
    c = V.pixels(spark, d).groupBy("frame", (b("r") * 256 + b("g") * 16 + b("b")).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("n"), "bin"))).where("k <= 3").select("frame", "k", "bin", "n")


@query(
    "skin_share",
    V.ctes("pixels") + " SELECT frame, avg((r > 0.35 AND g > 0.2 AND b > 0.15 AND r > g AND g > b AND greatest(r, g, b) - least(r, g, b) > 0.1)::INT) AS skin FROM pixels GROUP BY frame",
)
def skin_share(spark, d):
    p = F.expr("r > 0.35 and g > 0.2 and b > 0.15 and r > g and g > b and greatest(r, g, b) - least(r, g, b) > 0.1")
    return V.pixels(spark, d).groupBy("frame").agg(F.avg(p.cast("int")).alias("skin"))


@query(
    "colour_fingerprint",
    V.ctes("pixels")
    + " SELECT frame, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(sqrt(greatest(0, avg({c} * {c}) - avg({c}) * avg({c}))), 6) AS sd_{c}" for c in "rgb") + " FROM pixels GROUP BY frame",
)
def colour_fingerprint(spark, d):
    out = []
    for c in "rgb":
        out += [r6(F.avg(c)).alias(f"mean_{c}"), r6(F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c)))).alias(f"sd_{c}")]
    return V.pixels(spark, d).groupBy("frame").agg(*out)


@query(
    "image_statistics",
    V.ctes("pixels")
    + """, s AS (SELECT min(r) AS lo, max(r) AS hi, avg(r) AS mean, count(*) AS n FROM pixels), b AS (SELECT least(9999, floor((r - lo) / (hi - lo) * 10000))::BIGINT AS bin, count(*) AS k FROM pixels, s GROUP BY 1),
    c AS (SELECT bin, sum(k) OVER (ORDER BY bin) AS cum FROM b)
    SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean, round(lo + (hi - lo) * (SELECT min(bin) FROM c WHERE cum >= greatest(1, floor(n * 0.5))) / 10000, 6) AS p50,
      round(lo + (hi - lo) * (SELECT min(bin) FROM c WHERE cum >= greatest(1, floor(n * 0.9))) / 10000, 6) AS p90, round(lo + (hi - lo) * (SELECT min(bin) FROM c WHERE cum >= greatest(1, floor(n * 0.99))) / 10000, 6) AS p99 FROM s""",
)
def image_statistics(spark, d):
    """Range, mean and percentiles from a histogram of 10,000 bins; only bins pass through one task."""
    p = V.pixels(spark, d).select("r")
    s = p.agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg("r").alias("mean"), F.count("*").alias("n"))
    bins = p.crossJoin(F.broadcast(s)).groupBy(F.least(F.lit(9999), F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10000)).alias("bin")).agg(F.count("*").alias("k"))
    cum = bins.withColumn("cum", F.sum("k").over(Window.orderBy("bin"))).crossJoin(F.broadcast(s))
    at = lambda q: F.min(F.when(F.col("cum") >= F.greatest(F.lit(1), F.floor(F.col("n") * q)), F.col("bin")))
    out = cum.groupBy("lo", "hi", "mean").agg(*[at(q).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])
    scaled = [r6(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col(n) / 10000).alias(n) for n in ("p50", "p90", "p99")]
    return out.select(r6("lo").alias("lo"), r6("hi").alias("hi"), r6("mean").alias("mean"), *scaled)


@query(
    "frame_deltas",
    V.ctes("samples")
    + """, x AS (SELECT src, t - lag(t) OVER (PARTITION BY src ORDER BY t, pos) AS dt FROM samples), y AS (SELECT src, count(*) AS n, min(dt) AS lo, max(dt) AS hi, avg(dt) AS mean, coalesce(stddev_samp(dt), 0) AS sd, count(DISTINCT round(dt * 1e6)) AS kinds
      FROM x WHERE dt IS NOT NULL GROUP BY src)
    SELECT src, n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean, round(sd, 6) AS sd, kinds, n >= 30 AND kinds >= 2 AND ((hi - lo) / mean >= 0.02 OR sd / mean >= 0.01) AS vfr FROM y""",
)
def frame_deltas(spark, d):
    """Frame timing of a source and whether its rate is likely variable."""
    x = V.samples(spark, d).select("src", (F.col("t") - F.lag("t").over(Window.partitionBy("src").orderBy("t", "pos"))).alias("dt")).where("dt is not null")
    y = x.groupBy("src").agg(F.count("*").alias("n"), F.min("dt").alias("lo"), F.max("dt").alias("hi"), F.avg("dt").alias("mean"), F.coalesce(F.stddev_samp("dt"), F.lit(0.0)).alias("sd"), F.count_distinct(F.round(F.col("dt") * 1e6)).alias("kinds"))
    vfr = F.expr("n >= 30 and kinds >= 2 and ((hi - lo) / mean >= 0.02 or sd / mean >= 0.01)")
    return y.select("src", "n", *[r6(c).alias(c) for c in ("lo", "hi", "mean", "sd")], "kinds", vfr.alias("vfr"))


@query("loudness", "SELECT vec_id, round(greatest(-100, 20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)))), 6) AS rms_db, round(20 * log10(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 6) AS peak_db FROM embeddings")
def loudness(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    peak = F.array_max(F.transform(x, lambda v: F.abs(v)))
    return V.table(spark, d, "embeddings").select("vec_id", r6(F.greatest(F.lit(-100.0), 20 * F.log10(F.sqrt(total / F.size("embedding"))))).alias("rms_db"), r6(20 * F.log10(peak)).alias("peak_db"))


@query(
    "zero_crossings",
    """WITH e AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 AS m FROM embeddings),
    x AS (SELECT vec_id, k, embedding[k]::DOUBLE - m >= 0 AS up FROM e, (SELECT unnest(range(1, 65)) AS k) n), y AS (SELECT vec_id, up <> lag(up) OVER (PARTITION BY vec_id ORDER BY k) AS flip FROM x)
    SELECT vec_id, count(*) FILTER (flip) / 63::DOUBLE AS zcr FROM y GROUP BY vec_id""",
)
def zero_crossings(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / 64
    e = V.table(spark, d, "embeddings").select("vec_id", x.alias("x"), mean.alias("m")).select("vec_id", F.expr("transform(x, v -> v - m >= 0)").alias("up"))
    flips = F.expr("aggregate(sequence(1, size(up) - 1), 0, (a, i) -> a + if(up[i] <> up[i - 1], 1, 0))")
    return e.select("vec_id", (flips / (F.size("up") - 1).cast("double")).alias("zcr"))


@query("waveform_scope", V.ctes("pixels") + f" SELECT x * 32 AS column_, floor(least(1, {LUMA_SQL}) * 255 + 0.5)::INTEGER AS level, round(log2(count(*) + 1) * 0.2, 6) AS v FROM pixels GROUP BY 1, 2")
def waveform_scope(spark, d):
    g = V.pixels(spark, d).groupBy((F.col("x") * 32).alias("column_"), F.floor(F.least(F.lit(1.0), luma()) * 255 + 0.5).cast("int").alias("level"))
    return g.agg(r6(F.log2(F.count("*") + 1) * 0.2).alias("v"))


@query("timeline_duration", V.ctes("clips") + ' SELECT timeline, max("start" + dur) AS duration, count(DISTINCT track) AS tracks FROM clips GROUP BY timeline')
def timeline_duration(spark, d):
    return V.clips(spark, d).groupBy("timeline").agg(F.max(F.col("start") + F.col("dur")).alias("duration"), F.count_distinct("track").alias("tracks"))


@query("minimum_gain", V.ctes("clips") + " SELECT timeline, least(6, greatest(0, min(CASE WHEN off = 0 THEN 6 ELSE off - 2 END)))::BIGINT AS gain FROM clips WHERE kind = 'audio' GROUP BY timeline")
def minimum_gain(spark, d):
    gain = F.coalesce(F.when(F.col("off") != 0, F.col("off") - 2), F.lit(6))
    return V.clips(spark, d).where("kind = 'audio'").groupBy("timeline").agg(F.least(F.lit(6), F.greatest(F.lit(0), F.min(gain))).cast("long").alias("gain"))


@query(
    "mask_metrics",
    V.ctes("pixels")
    + """, m AS (SELECT a.frame, (a.r > 0.5)::INT AS p, (b.r > 0.5)::INT AS q FROM pixels a JOIN pixels b ON b.frame = a.frame + 1 AND b.x = a.x AND b.y = a.y)
    SELECT frame, avg(p) AS coverage, count(*) FILTER (p = 1 AND q = 1) / greatest(1, count(*) FILTER (p = 1 OR q = 1))::DOUBLE AS iou FROM m GROUP BY frame""",
)
def mask_metrics(spark, d):
    """Coverage of a frame's mask and its overlap with the next frame's."""
    p = V.pixels(spark, d).select("frame", "x", "y", (F.col("r") > 0.5).alias("p"))
    q = p.select((F.col("frame") - 1).alias("frame"), "x", "y", F.col("p").alias("q"))
    m = p.join(q, ["frame", "x", "y"])
    return m.groupBy("frame").agg(F.avg(F.col("p").cast("int")).alias("coverage"), (F.count_if(F.col("p") & F.col("q")) / F.greatest(F.lit(1), F.count_if(F.col("p") | F.col("q"))).cast("double")).alias("iou"))


@query(
    "depth_metrics",
    V.ctes("pixels")
    + """ SELECT frame, avg((g * 60 > 0 AND g * 60 <= 50)::INT) AS valid, round(min(g * 60) FILTER (g > 0), 6) AS near, round(max(g * 60), 6) AS far, bool_or(g <= 0) AS has_hole, bool_or(g * 60 > 50) AS has_far FROM pixels GROUP BY frame""",
)
def depth_metrics(spark, d):
    m = F.col("g") * 60
    return V.pixels(spark, d).groupBy("frame").agg(
        F.avg(((m > 0) & (m <= 50)).cast("int")).alias("valid"), r6(F.min(F.when(F.col("g") > 0, m))).alias("near"), r6(F.max(m)).alias("far"), F.bool_or(F.col("g") <= 0).alias("has_hole"), F.bool_or(m > 50).alias("has_far")
    )


@query("flow_magnitude", V.ctes("pixels") + " SELECT frame, round(avg(sqrt((r - 0.5) * (r - 0.5) + (b - 0.5) * (b - 0.5))), 6) AS flow FROM pixels WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY frame")
def flow_magnitude(spark, d):
    return V.pixels(spark, d).where("x % 2 = 0 and y % 2 = 0").groupBy("frame").agg(r6(F.avg(F.hypot(F.col("r") - 0.5, F.col("b") - 0.5))).alias("flow"))


@query(
    "image_comparison",
    V.ctes("pixels") + " SELECT a.frame, round(max(abs(a.r - b.r)), 6) AS worst, round(avg(abs(a.r - b.r)), 6) AS mean FROM pixels a JOIN pixels b ON b.frame = a.frame + 1 AND b.x = a.x AND b.y = a.y GROUP BY a.frame",
)
def image_comparison(spark, d):
    p = V.pixels(spark, d).select("frame", "x", "y", "r")
    m = p.join(p.select((F.col("frame") - 1).alias("frame"), "x", "y", F.col("r").alias("s")), ["frame", "x", "y"])
    return m.groupBy("frame").agg(r6(F.max(F.abs(F.col("r") - F.col("s")))).alias("worst"), r6(F.avg(F.abs(F.col("r") - F.col("s")))).alias("mean"))


@query("reason_codes", V.ctes("ev") + " SELECT src, floor(t)::BIGINT AS hour, list_sort(list(DISTINCT event_type)) AS codes FROM ev GROUP BY 1, 2")
def reason_codes(spark, d):
    return V.timed_events(spark, d).groupBy("src", F.floor("t").alias("hour")).agg(F.array_sort(F.collect_set("event_type")).alias("codes"))


@query("linked_clips", V.ctes("clips") + """ SELECT v.timeline, v.clip AS video, a.clip AS audio FROM clips v JOIN clips a ON a.timeline = v.timeline AND a.kind = 'audio' AND a.dur = v.dur WHERE v.kind = 'video'""")
def linked_clips(spark, d):
    c = V.clips(spark, d)
    a = c.where("kind = 'audio'").select("timeline", "dur", F.col("clip").alias("audio"))
    return c.where("kind = 'video'").join(a, ["timeline", "dur"]).select("timeline", F.col("clip").alias("video"), "audio")


GROW = 0.15  # landmark boxes are wider than faces
BOX_SQL = f"box AS (SELECT pos, track, x - {GROW} AS x, y - {GROW} AS y, w + {2 * GROW} AS w, h + {2 * GROW} AS h FROM faces)"
IOU_SQL = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(
    "iou_matches",
    V.ctes("faces")
    + f""", {BOX_SQL}, i AS (SELECT a.pos, a.track, b.track AS other, {IOU_SQL} AS both_, a.w * a.h + b.w * b.h AS areas, b.x, b.y, b.w, b.h FROM box a JOIN box b ON a.pos = b.pos AND a.track <> b.track),
    j AS (SELECT *, round(both_ / greatest(areas - both_, 1e-9), 9) AS iou FROM i)
    SELECT pos, track, other, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY pos, track ORDER BY iou DESC, x, y, w DESC, h DESC, other) AS n FROM j WHERE iou >= 0.03) q WHERE n = 1""",
)
def iou_matches(spark, d):
    """For each box of a sample the other one that overlaps it most; ties by place and size."""
    a = V.faces(spark, d).select("pos", "track", (F.col("x") - GROW).alias("x"), (F.col("y") - GROW).alias("y"), (F.col("w") + 2 * GROW).alias("w"), (F.col("h") + 2 * GROW).alias("h"))
    b = a.select("pos", F.col("track").alias("other"), *[F.col(c).alias("o" + c) for c in "xywh"])
    inter = F.expr("greatest(0, least(x + w, ox + ow) - greatest(x, ox)) * greatest(0, least(y + h, oy + oh) - greatest(y, oy))")
    j = a.join(b, "pos").where("track <> other").withColumn("both", inter)
    j = j.withColumn("iou", F.round(F.col("both") / F.greatest(F.expr("w * h + ow * oh") - F.col("both"), F.lit(1e-9)), 9)).where("iou >= 0.03")
    w = Window.partitionBy("pos", "track").orderBy(F.desc("iou"), "ox", "oy", F.desc("ow"), F.desc("oh"), "other")
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("pos", "track", "other", r6("iou").alias("iou"))


@query(
    "cluster_similarity",
    """WITH m AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k) n GROUP BY label, k)
    SELECT a.label AS a, b.label AS b, round(sum(a.v * b.v) / sqrt(greatest(1e-12, sum(a.v * a.v)) * greatest(1e-12, sum(b.v * b.v))), 6) AS cosine FROM m a JOIN m b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2""",
)
def cluster_similarity(spark, d):
    """Cosine of every pair of label centroids; centroids are few, vectors are averaged first."""
    m = V.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    b = m.select(F.col("label").alias("b"), "k", F.col("v").alias("u"))
    p = m.join(b, "k").where("label < b").groupBy(F.col("label").alias("a"), "b")
    norm = lambda c: F.greatest(F.lit(1e-12), F.sum(F.col(c) * F.col(c)))
    return p.agg(r6(F.sum(F.col("v") * F.col("u")) / F.sqrt(norm("v") * norm("u"))).alias("cosine"))


@query(
    "attribution_lookup",
    V.ctes("words")
    + """, a AS (SELECT word_id % 97 AS id, max_by(luma, word_id) AS score FROM words GROUP BY 1) SELECT w.word_id, coalesce(a.score, 0) AS score FROM words w LEFT JOIN a ON a.id = w.word_id % 101""",
)
def attribution_lookup(spark, d):
    """Of attributions with one key the last writer wins; a missing one scores 0."""
    w = V.words(spark, d)
    a = w.groupBy((F.col("word_id") % 97).alias("id")).agg(F.max_by("luma", "word_id").alias("score"))
    return w.withColumn("id", F.col("word_id") % 101).join(a, "id", "left").select("word_id", F.coalesce("score", F.lit(0.0)).alias("score"))


@query("unknown_features", V.ctes("clips") + " SELECT DISTINCT track, off FROM clips WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest([0, 1, 2, 3, 5, 8]) AS id) k WHERE k.id = clips.off)")
def unknown_features(spark, d):
    known = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 5, 8)], "off long")
    return V.clips(spark, d).select("track", "off").distinct().join(F.broadcast(known), "off", "left_anti").select("track", "off")

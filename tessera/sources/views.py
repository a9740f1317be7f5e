"""The driver's tables in the shape of media tables.

A user's events are one source, a conversation's words are spoken in the source of its number, so sources grow with the tables. One
media second is ten hours of the event stream, which puts a source's samples about a second apart. Samples and marks are all events, words come from the conversations. Each view has its
SQL twin in ``SQL``, for oracles. With ``shared`` all users and conversations share ten sources and a media second is one hour, so every word lies among samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = {"view": "speechLike", "click": "speechLike", "signup": "musicLike", "error": "silence", "purchase": "unknown"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """(event_id, src, t, event_type, luma): every event on its source's clock."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    src, second = (F.col("user_id") % 10, 3600000000.0) if shared else (F.col("user_id"), 36000000000.0)
    return table(spark, sf_dir, "events").select(
        "event_id", src.alias("src"), (micros / F.lit(second)).alias("t"), "event_type", (F.col("value") / 500).alias("luma")
    )


def samples(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """(pos, src, t, luma, skin): video samples."""
    return timed_events(spark, sf_dir, shared).select(F.col("event_id").alias("pos"), "src", "t", "luma", (F.col("event_id") % 17 / 17.0).alias("skin"))


def faces(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """(pos, src, t, track, x, y, w, h, mouth): zero to three faces a sample."""
    each = timed_events(spark, sf_dir, shared).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 5 % 4).cast("int")))).where(F.col("k") < F.col("event_id") % 5 % 4)
    track = (F.col("event_id") + F.col("k") * 7) % 6
    return each.select(
        F.col("event_id").alias("pos"),
        "src",
        "t",
        F.concat(F.lit("T"), track.cast("string")).alias("track"),
        ((F.col("event_id") * 13 + F.col("k") * 29) % 80 / 100.0).alias("x"),
        ((F.col("event_id") * 7 + F.col("k") * 31) % 70 / 100.0).alias("y"),
        (0.05 + (F.col("event_id") + F.col("k")) % 15 / 100.0).alias("w"),
        (0.05 + (F.col("event_id") + F.col("k") * 3) % 20 / 100.0).alias("h"),
        ((F.col("event_id") * 3 + F.col("k") * 5) % 10 / 10.0).alias("mouth"),
    )


def words(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """(word_id, src, t, speaker, luma): the words of all conversations, ten seconds a turn, a quarter of a second a word, the role as speaker.

    An identifier holds conversation, turn (12 bits) and position (20 bits)."""
    each = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return each.where("word <> ''").select(
        (F.col("conv_id") * 4294967296 + F.col("turn").cast("long") * 1048576 + F.col("i")).alias("word_id"),
        (F.col("conv_id") % 10 if shared else F.col("conv_id")).alias("src"),
        ((F.col("turn").cast("long") * 600000 + F.col("i") * 15000) / F.lit(60000.0)).alias("t"),
        F.col("role").alias("speaker"),
        (F.length("word") % 10 / 20.0).alias("luma"),
    )


def segments(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """(seg, src, start, end, kind, conf): each mark lasts until the source's next one."""
    kind = F.create_map(*[F.lit(x) for item in KINDS.items() for x in item])[F.col("event_type")]
    marks = timed_events(spark, sf_dir, shared)
    nxt = F.lead("t").over(Window.partitionBy("src").orderBy("t", "event_id"))
    return marks.select(F.col("event_id").alias("seg"), "src", F.col("t").alias("start"), nxt.alias("end"), kind.alias("kind"), F.col("luma").alias("conf")).where("end is not null")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timeline, track, kind, clip, start, dur, off): clips in ticks, a timeline for each order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("timeline"),
        F.col("l_returnflag").alias("track"),
        F.when(F.col("l_returnflag") == "R", "audio").when(F.col("l_returnflag") == "N", "video").otherwise("data").alias("kind"),
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("clip"),
        (F.col("l_linenumber").cast("long") * 60000).alias("start"),
        (F.col("l_quantity").cast("long") * 6000).alias("dur"),
        (F.col("l_discount") * 100).cast("long").alias("off"),
    )


SQL = {
    "ev": """ev AS (SELECT event_id, user_id AS src, (epoch_us(ts) - 1704067200000000) / 36000000000::DOUBLE AS t,
        event_type, value / 500::DOUBLE AS luma FROM events)""",
    "samples": """samples AS (SELECT event_id AS pos, src, t, luma, (event_id % 17) / 17::DOUBLE AS skin FROM ev)""",
    "faces": """faces AS (SELECT event_id AS pos, src, t, 'T' || ((event_id + k * 7) % 6)::VARCHAR AS track,
        ((event_id * 13 + k * 29) % 80) / 100::DOUBLE AS x, ((event_id * 7 + k * 31) % 70) / 100::DOUBLE AS y,
        0.05::DOUBLE + ((event_id + k) % 15) / 100::DOUBLE AS w, 0.05::DOUBLE + ((event_id + k * 3) % 20) / 100::DOUBLE AS h,
        ((event_id * 3 + k * 5) % 10) / 10::DOUBLE AS mouth
        FROM ev JOIN (SELECT unnest(range(0, 4)) AS k) n ON k < event_id % 5 % 4)""",
    "words": """words AS (SELECT conv_id * 4294967296 + turn::BIGINT * 1048576 + i AS word_id, conv_id AS src, (turn::BIGINT * 600000 + i * 15000) / 60000::DOUBLE AS t,
        role AS speaker, (length(word) % 10) / 20::DOUBLE AS luma
        FROM (SELECT conv_id, turn, role, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM (SELECT *, string_split(text, ' ') AS w FROM conversations) c) x WHERE word <> '')""",
    "segments": """segments AS (SELECT * FROM (SELECT event_id AS seg, src, t AS "start", lead(t) OVER (PARTITION BY src ORDER BY t, event_id) AS "end",
        CASE event_type WHEN 'view' THEN 'speechLike' WHEN 'click' THEN 'speechLike' WHEN 'signup' THEN 'musicLike' WHEN 'error' THEN 'silence' ELSE 'unknown' END AS kind,
        luma AS conf FROM ev) s WHERE "end" IS NOT NULL)""",
    "clips": """clips AS (SELECT l_orderkey AS timeline, l_returnflag AS track,
        CASE l_returnflag WHEN 'R' THEN 'audio' WHEN 'N' THEN 'video' ELSE 'data' END AS kind,
        concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, (l_extendedprice::DECIMAL(12,2))::VARCHAR) AS clip,
        l_linenumber::BIGINT * 60000 AS "start", l_quantity::BIGINT * 6000 AS dur, trunc(l_discount * 100)::BIGINT AS off FROM lineitem)""",
}


SHARED = {
    "ev": SQL["ev"].replace("user_id AS src", "user_id % 10 AS src").replace("36000000000::", "3600000000::"),
    "words": SQL["words"].replace("conv_id AS src", "conv_id % 10 AS src"),
}


def ctes(*names: str, shared: bool = False) -> str:
    """``WITH`` and the named views; all but ``clips`` stand on ``ev``."""
    needed = ([] if set(names) <= {"clips"} else ["ev"]) + [n for n in SQL if n in names and n != "ev"]
    of = SQL | SHARED if shared else SQL
    return "WITH RECURSIVE " + ",\n".join(of[n] for n in needed)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, x, y, r, g, b): every vector as a frame of 8 by 8 pixels."""
    v = F.col("v").cast("double")
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    each = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "v"))
    return each.select(
        "frame", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), unit(0.5 + v * 2).alias("r"), unit(0.45 + v).alias("g"), unit(0.4 - v).alias("b")
    )


def frames(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(frame, r, g, b): every vector as a frame of 8 by 8 pixels, an array by rows for each channel; ``more`` columns of its row stay."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    of = lambda f: F.transform("embedding", lambda v: unit(f(v.cast("double"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), *more, of(lambda v: 0.5 + v * 2).alias("r"), of(lambda v: 0.45 + v).alias("g"), of(lambda v: 0.4 - v).alias("b"))


def pixel_neighbours(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Every frame's pixels with those of the next ``n`` - 1 frames: r, g, b, r2, g2, b2... Whole frames are
    joined before they are laid out in pixels."""
    whole = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whole.select(F.col("vec_id").alias("frame"), F.col("embedding").alias("e1"))
    for k in range(2, n + 1):
        out = out.join(whole.select((F.col("vec_id") - (k - 1)).alias("frame"), F.col("embedding").alias(f"e{k}")), "frame")
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    each = out.select("frame", F.posexplode(F.arrays_zip(*[f"e{k}" for k in range(1, n + 1)])).alias("i", "v"))
    channels = []
    for k in range(1, n + 1):
        v, name = F.col(f"v.e{k}").cast("double"), str(k) if k > 1 else ""
        channels += [unit(0.5 + v * 2).alias("r" + name), unit(0.45 + v).alias("g" + name), unit(0.4 - v).alias("b" + name)]
    return each.select("frame", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), *channels)


SQL["pixels"] = """pixels AS (SELECT vec_id AS frame, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5 + v * 2)) AS r,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.45 + v)) AS g, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4 - v)) AS b
    FROM (SELECT vec_id, k AS i, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS k) n) e)"""

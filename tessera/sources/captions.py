"""Caption and transcript files: WebVTT, SRT, word records and ASR output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("schema", "word_id", "word")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("source_time_ticks", T.LongType()), T.StructField("source_time_end_ticks", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("speaker_id", "speaker_label")]
    + [T.StructField("timeline_time_ticks", T.LongType()), T.StructField("timeline_time_end_ticks", T.LongType())]
)


def _seconds(text: Column, mark: str) -> Column:
    pattern = rf"^(\d+):(\d+):(\d+){mark}(\d+)$"
    part = lambda n: F.regexp_extract(text, pattern, n).cast("double")
    return F.when(text.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000)


def _cues(files: DataFrame, mark: str, speaker: str, skip_first: bool) -> DataFrame:
    """Blocks between blank lines; a block without a proper timing line is skipped."""
    text = F.regexp_replace(F.regexp_replace("value", "\r\n|\r", "\n"), "^﻿", "")
    blocks = files.select("file", F.posexplode(F.split(text, "\n[ \t]*\n")).alias("block", "body"))
    if skip_first:
        blocks = blocks.where("block > 0")
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    b = blocks.withColumn("lines", lines)
    has = lambda i: F.coalesce(F.get("lines", F.lit(i)).contains("-->"), F.lit(False))
    at = F.when(has(0), 0).when(has(1), 1)
    b = b.withColumn("at", at).where("at is not null").withColumn("times", F.split(F.get("lines", F.col("at")), "-->"))
    b = b.withColumn("start", _seconds(F.trim(F.get("times", F.lit(0))), mark)).withColumn("end", _seconds(F.split(F.trim(F.get("times", F.lit(1))), " ")[0], mark))
    whole = F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), "\n")
    b = b.where("start is not null and end is not null").withColumn("whole", F.trim(whole))
    name = F.regexp_extract("whole", speaker, 1)
    return b.select("file", "block", "start", "end", F.trim(F.regexp_replace("whole", speaker, "")).alias("text"), F.when(name != "", F.trim(name)).alias("speaker")).where("text <> ''")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """Cues (file, block, start, end, text, speaker) of WebVTT files; ``<v Name>`` names a speaker."""
    return _cues(_files(spark, path), r"\.", r"^<v ([^>]+)>", skip_first=True)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT files; ``[Name]`` names a speaker."""
    return _cues(_files(spark, path), ",", r"^\[([^\]]+)\]\s*", skip_first=False)


def first_existing(candidates: DataFrame) -> DataFrame:
    """Of files (asset, path) each asset's captions: a .vtt before a .srt, then by name; nothing else counts."""
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    ranked = candidates.withColumn("rank", F.when(kind == "vtt", 0).when(kind == "srt", 1)).where("rank is not null")
    return ranked.groupBy("asset").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def env_values(lines: DataFrame) -> DataFrame:
    """Lines (file, n, line) of KEY=VALUE files to (file, key, value): comments and lines without a key or ``=`` don't
    count, one pair of quotes goes, and the last value of a key stays."""
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    own = lines.select("file", "n", line.alias("line")).where("line <> '' and not startswith(line, '#') and instr(line, '=') > 0")
    key = F.trim(F.regexp_extract("line", r"(?s)^([^=]*)=", 1))
    value = F.trim(F.regexp_extract("line", r"(?s)^[^=]*=(.*)$", 1))
    bare = F.when(value.rlike(r"""(?s)^(".*"|'.*')$""") & (F.length(value) >= 2), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    each = own.select("file", "n", key.alias("key"), bare.alias("value")).where("key <> ''")
    return each.groupBy("file", "key").agg(F.max_by("value", "n").alias("value"))


def sorted_json(rows: DataFrame) -> DataFrame:
    """One JSON object a line with its keys in order, nulls left out."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def read_projects(spark: SparkSession, path: str, versions: tuple[int, ...], with_context: bool = False) -> DataFrame:
    """Project documents of known versions; an unknown version fails the scan. Their visual context is dropped unless asked for."""
    schema = "schemaVersion int, name string, clips array<struct<id: string, start: long>>, visualContext string"
    read = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    known = F.assert_true(F.coalesce(F.col("schemaVersion").isin(*versions), F.lit(False)), F.concat(F.lit("unknown schemaVersion "), F.coalesce(F.col("schemaVersion").cast("string"), F.lit("null"))))
    checked = read.where(known.isNull())
    return checked if with_context else checked.drop("visualContext")


def _clock(s: Column, mark: str) -> Column:
    from tessera.functions.scalars import timestamp_text

    return timestamp_text(s, mark)


def vtt_text(cues: DataFrame, by: str = "file") -> DataFrame:
    """One WebVTT text for each file."""
    body = F.concat(_clock(F.col("start"), "."), F.lit(" --> "), _clock(F.col("end"), "."), F.lit("\n"), F.coalesce(F.concat(F.lit("<v "), F.col("speaker"), F.lit(">")), F.lit("")), F.col("text"), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", body.alias("body"))))
    return cues.groupBy(by).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(ordered, lambda c: c["body"]), "")).alias("value"))


def srt_text(cues: DataFrame, by: str = "file") -> DataFrame:
    """One SRT text for each file, cues numbered from 1."""
    body = F.concat(_clock(F.col("start"), ","), F.lit(" --> "), _clock(F.col("end"), ","), F.lit("\n"), F.coalesce(F.concat(F.lit("["), F.col("speaker"), F.lit("] ")), F.lit("")), F.col("text"), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", body.alias("body"))))
    numbered = F.transform(ordered, lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), c["body"]))
    return cues.groupBy(by).agg(F.array_join(numbered, "").alias("value"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Word records, one JSON object a line; a bad line fails the scan."""
    return spark.read.schema(WORD).option("mode", "FAILFAST").json(path)


def asr_words(documents: DataFrame) -> DataFrame:
    """(file, value) of ASR output to words (file, pos, word, start_ms, end_ms).

    Either ``transcription`` entries with offsets in milliseconds, or ``segments`` with words whose t0 and t1 count
    10 milliseconds. Several words in one entry share its span evenly.
    """
    schema = (
        "struct<transcription: array<struct<text: string, offsets: struct<from: long, to: long>>>, segments: array<struct<words: array<struct<word: string, t0: double, t1: double>>>>>"
    )
    d = documents.select("file", F.from_json("value", schema).alias("d"))
    first = F.transform("d.transcription", lambda t: F.struct(t["text"].alias("text"), t["offsets"]["from"].cast("double").alias("a"), t["offsets"]["to"].cast("double").alias("b")))
    second = F.transform(F.flatten(F.transform("d.segments", lambda s: s["words"])), lambda w: F.struct(w["word"].alias("text"), (w["t0"] * 10).alias("a"), (w["t1"] * 10).alias("b")))
    e = d.select("file", F.posexplode(F.coalesce(first, second)).alias("entry", "e")).select("file", "entry", "e.*")
    parts = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    w = e.withColumn("n", F.size(parts)).select("file", "entry", "a", "b", "n", F.posexplode(parts).alias("k", "word"))
    share = (F.col("b") - F.col("a")) / F.col("n")
    return w.select("file", "entry", "k", "word", (F.col("a") + share * F.col("k")).alias("start_ms"), (F.col("a") + share * (F.col("k") + 1)).alias("end_ms"))


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """A .cube table as (file, size, i, r, g, b); files without size cubed rows give none."""
    lines = _files(spark, path).select("file", F.expr(r"filter(transform(split(value, '\\r?\\n'), x -> trim(x)), x -> x <> '' and not x like '#%')").alias("lines"))
    size = F.regexp_extract(F.array_join("lines", "\n"), r"LUT_3D_SIZE\s+(\d+)", 1).try_cast("int")
    rows = F.filter("lines", lambda x: x.rlike(r"^[-+0-9.eE]+\s+[-+0-9.eE]+\s+[-+0-9.eE]+$"))
    t = lines.select("file", size.alias("size"), rows.alias("rows")).where("size is not null and size(rows) = size * size * size")
    p = t.select("file", "size", F.posexplode("rows").alias("i", "row")).withColumn("v", F.split("row", r"\s+"))
    return p.select("file", "size", "i", *[F.col("v")[k].cast("double").alias(c) for k, c in enumerate("rgb")])

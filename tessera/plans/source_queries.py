"""Files written and read again: captions, word records, JSON, tables, images, projects."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from tessera.plans.registry import Registry
from tessera.sources import captions, fits, fits_files
from tessera.sources import views as V
from tessera.sources.scratch import new_folder

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

CUES = r"""WITH c AS (SELECT conv_id // 8 AS file, (conv_id % 3000) * 100.0::DOUBLE + turn * 3 AS start, (conv_id % 3000) * 100.0::DOUBLE + turn * 3 + 2.5 AS "end", role AS speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE text IS NOT NULL)
  SELECT file, start, "end", text, speaker FROM c WHERE text <> ''"""


def turns_as_cues(spark, d):
    """Every turn as a cue, a file for eight conversations."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    start = F.col("conv_id") % 3000 * 100.0 + F.col("turn") * 3
    c = V.table(spark, d, "conversations").where("text is not null").select(F.floor(F.col("conv_id") / 8).alias("file"), start.alias("start"), (start + 2.5).alias("end"), text.alias("text"), F.col("role").alias("speaker"))
    return c.where("text <> ''")


def _written(spark, texts, name):
    """One file for each row (file, value); gives the folder."""
    folder = new_folder(spark, name)
    texts.repartition("file").write.partitionBy("file").text(folder)
    return folder


def _file_number(df):
    return df.withColumn("file", F.regexp_extract("file", r"file=(\d+)", 1).cast("long"))


@query("vtt_round_trip", CUES)
def vtt_round_trip(spark, d):
    folder = _written(spark, captions.vtt_text(turns_as_cues(spark, d)), "vtt")
    return _file_number(captions.read_vtt(spark, folder + "/*/*.txt")).select("file", "start", "end", "text", "speaker")


@query("srt_round_trip", CUES)
def srt_round_trip(spark, d):
    folder = _written(spark, captions.srt_text(turns_as_cues(spark, d)), "srt")
    return _file_number(captions.read_srt(spark, folder + "/*/*.txt")).select("file", "start", "end", "text", "speaker")


@query("word_records", V.ctes("words") + " SELECT word_id::VARCHAR AS word_id, round(t * 60000)::BIGINT AS source_time_ticks, speaker AS speaker_id FROM words")
def word_records(spark, d):
    """Words as one JSON record a line, read back by their schema."""
    w = V.words(spark, d).select(F.col("word_id").cast("string").alias("word_id"), F.round(F.col("t") * 60000).cast("long").alias("source_time_ticks"), F.col("speaker").alias("speaker_id"))
    folder = new_folder(spark, "words")
    captions.sorted_json(w).write.text(folder)
    return captions.read_words(spark, folder).select("word_id", "source_time_ticks", "speaker_id")


@query("json_lines", """SELECT '{"active":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"name":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"nation":' || c_nationkey::VARCHAR END || '}' AS value FROM customer""")
def json_lines(spark, d):
    """Records with sorted keys, one a line, as they stand in the file."""
    c = V.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("nation"), (F.col("c_custkey") % 2 == 0).alias("active"))
    folder = new_folder(spark, "lines")
    captions.sorted_json(c).write.text(folder)
    return spark.read.text(folder)


@query("json_documents", "SELECT o_custkey // 10 AS doc, count(*) AS samples, round(max(o_totalprice::DOUBLE), 2) AS most FROM orders GROUP BY 1")
def json_documents(spark, d):
    """Whole documents over several lines, one for ten customers with all their samples; a file is an array of a hundred documents, so files don't stay tiny as they grow in number."""
    o = V.table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 10).alias("doc"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("luma")).alias("s"))
    text = F.to_json(F.struct(F.col("doc"), F.collect_list("s").alias("samples")), {"pretty": "true"})
    documents = o.groupBy("doc").agg(text.alias("value")).groupBy(F.floor(F.col("doc") / 100).alias("file"))
    folder = _written(spark, documents.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value")), "documents")
    read = spark.read.schema("doc long, samples array<struct<id: long, luma: double>>").option("multiLine", True).option("mode", "FAILFAST").json(folder)
    s = read.select("doc", F.explode("samples").alias("s"))
    return s.groupBy("doc").agg(F.count("*").alias("samples"), F.round(F.max("s.luma"), 2).alias("most"))


@query("asr_words", r"""WITH c AS (SELECT conv_id, turn, turn % 2 = 0 AS first, list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM conversations WHERE text IS NOT NULL),
  w AS (SELECT conv_id, turn, first, len(ws) AS n, unnest(ws) AS word, unnest(range(0, len(ws))) AS k FROM c)
  SELECT conv_id, turn, k, word, round(CASE WHEN first THEN turn * 5000 + 4000 / n::DOUBLE * k ELSE turn * 5000 + k * 200 END, 6) AS start_ms, round(CASE WHEN first THEN turn * 5000 + 4000 / n::DOUBLE * (k + 1) ELSE turn * 5000 + k * 200 + 150 END, 6) AS end_ms FROM w""")
def asr_words(spark, d):
    """Recognised words in both shapes: a turn as one entry that its words share, or word by word."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    at = F.col("turn").cast("long") * 5000
    words = F.filter(F.split(text, " "), lambda x: x != "")
    one = F.to_json(F.struct(F.array(F.struct(text.alias("text"), F.struct(at.alias("from"), (at + 4000).alias("to")).alias("offsets"))).alias("transcription")))
    each = F.transform(words, lambda x, k: F.struct(x.alias("word"), ((at + k * 200) / 10).alias("t0"), ((at + k * 200 + 150) / 10).alias("t1")))
    many = F.to_json(F.struct(F.array(F.struct(each.alias("words"))).alias("segments")))
    c = V.table(spark, d, "conversations").where("text is not null").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file"), F.when(F.col("turn") % 2 == 0, one).otherwise(many).alias("value"))
    name = F.split("file", "/")
    return captions.asr_words(c).select(name[0].cast("long").alias("conv_id"), name[1].cast("int").alias("turn"), (F.col("entry") + F.col("k")).alias("k"), "word", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"))


@query("cube_tables", """SELECT s.n AS size, i, round(i / (s.n * s.n * s.n)::DOUBLE, 6) AS r, round(0.5 + i / 1000::DOUBLE, 6) AS g, round(1 - i / 500::DOUBLE, 6) AS b FROM (SELECT unnest([2, 3, 4]) AS n) s, (SELECT unnest(range(0, 64)) AS i) k WHERE i < s.n * s.n * s.n""")
def cube_tables(spark, d):
    """Colour tables as files; one whose rows don't match its size gives none."""
    rows = []
    for n in (2, 3, 4, 5):
        body = [f"{i / n**3:.6f} {0.5 + i / 1000:.6f} {1 - i / 500:.6f}" for i in range(n**3 if n < 5 else 100)]
        rows.append((n, "\n".join(["# made by a rule", f"LUT_3D_SIZE {n}", *body])))
    folder = _written(spark, spark.createDataFrame(rows, "file int, value string"), "cube")
    return captions.read_cube(spark, folder + "/*/*.txt").select("size", "i", *[F.round(c, 6).alias(c) for c in "rgb"])


def _as_fits(batches):
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -32", "NAXIS   =                    2", "NAXIS1  =                    8", "NAXIS2  =                    8", "END"]
    head = "".join(c.ljust(80) for c in cards).ljust(2880).encode()
    for whole in batches:
        for at in range(0, len(whole), 256):
            b = whole.iloc[at : at + 256]
            yield pd.DataFrame({"path": b["vec_id"].astype(str), "content": [head + struct.pack(">64f", *v).ljust(2880, b"\0") for v in b["embedding"]]})


def images(spark, d):
    """Every vector as an image file of 8 by 8 pixels."""
    return V.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(_as_fits, "path string, content binary")


@query("fits_images", "SELECT vec_id, y, embedding[y * 8 + 1 : y * 8 + 8]::DOUBLE[] AS row FROM embeddings, (SELECT unnest(range(0, 8)) AS y) k")
def fits_images(spark, d):
    return fits.scan_lines(images(spark, d)).select(F.col("file").cast("long").alias("vec_id"), "y", "row")


@query("fits_lines", "SELECT vec_id, y, round(list_sum(embedding[y * 8 + 1 : y * 8 + 8]::DOUBLE[]), 9) AS total FROM embeddings, (SELECT unnest(range(3, 5)) AS y) k")
def fits_lines(spark, d):
    """Two scan lines of each image; no others are decoded."""
    total = F.aggregate("row", F.lit(0.0), lambda s, v: s + v)
    return fits.scan_lines(images(spark, d), 3, 5).select(F.col("file").cast("long").alias("vec_id"), "y", F.round(total, 9).alias("total"))


_SHEETS = """WITH i AS (SELECT vec_id // 64 AS file, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS y, count(*) OVER (PARTITION BY vec_id // 64) AS height, embedding FROM embeddings)"""


def image_files(spark, d):
    """Sixty-four vectors make an image of as many lines; gives the folder of the files."""
    one = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    e = V.table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).alias("file")).agg(one.alias("lines"))
    images = e.select(F.col("file").cast("string").alias("file"), F.size(F.col("lines")[0]["embedding"]).alias("width"), F.flatten("lines.embedding").alias("pixels"))
    folder = new_folder(spark, "fits")
    fits_files.write_images(images, folder)
    return folder


def _sheet(df):
    return df.withColumn("file", F.regexp_extract("file", r"(\d+)\.fits$", 1).cast("long"))


@query("fits_files", _SHEETS + " SELECT file, height::INTEGER AS height, y::INTEGER AS y, round(list_sum(embedding::DOUBLE[]), 9) AS total FROM i")
def fits_files_query(spark, d):
    """All lines of all image files, in splits that end within files."""
    total = F.round(F.aggregate("row", F.lit(0.0), lambda s, v: s + v), 9).alias("total")
    return _sheet(fits_files.read_lines(spark, image_files(spark, d), split=4096)).select("file", "height", "y", total)


@query("fits_row_range", _SHEETS + """ SELECT file, y::INTEGER AS y, round(list_sum(embedding::DOUBLE[]), 9) AS total, (len(embedding) * 4 + CASE WHEN y = least_y THEN 2880 ELSE 0 END)::BIGINT AS bytes_read
      FROM (SELECT *, min(y) OVER (PARTITION BY file) AS least_y FROM i WHERE y BETWEEN 10 AND 12)""")
def fits_row_range(spark, d):
    """Three lines of each image and the bytes that were read for them: no others, and the header once."""
    lines = fits_files.read_lines(spark, image_files(spark, d)).where("y >= 10 and y < 13")
    return _sheet(lines).select("file", "y", F.round(F.aggregate("row", F.lit(0.0), lambda s, v: s + v), 9).alias("total"), "bytes_read")


_PIXELS = _SHEETS + """, p AS (SELECT file, unnest(embedding)::DOUBLE AS v FROM i), s AS (SELECT file, min(v) AS lo, max(v) AS hi, avg(v) AS mean, count(*) AS n FROM p GROUP BY file),
      b AS (SELECT file, CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 9999) ELSE 0 END::BIGINT AS bin, count(*) AS k FROM p JOIN s USING (file) GROUP BY ALL),
      c AS (SELECT file, bin, sum(k) OVER (PARTITION BY file ORDER BY bin) AS up_to FROM b)"""


def _share(q: float) -> str:
    return f"round(lo + (SELECT min(bin) FROM c WHERE c.file = s.file AND up_to >= greatest(1, floor(n * {q}::DOUBLE))) / 9999::DOUBLE * (hi - lo), 9)"


@query("fits_statistics", _PIXELS + f" SELECT file, round(lo, 9) AS lo, round(hi, 9) AS hi, round(mean, 9) AS mean, n, {_share(0.5)} AS p50, {_share(0.9)} AS p90, {_share(0.99)} AS p99 FROM s")
def fits_statistics(spark, d):
    s = fits.statistics(_sheet(fits_files.read_lines(spark, image_files(spark, d))))
    return s.select("file", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "mean")], "n", *[F.round(c, 9).alias(c) for c in ("p50", "p90", "p99")])


@query("fits_stretch", _PIXELS + f" SELECT file, {_share(0.02)} AS black, {_share(0.995)} AS white FROM s")
def fits_stretch(spark, d):
    s = fits.stretch_range(_sheet(fits_files.read_lines(spark, image_files(spark, d))), 0.02, 0.995)
    return s.select("file", F.round("black", 9).alias("black"), F.round("white", 9).alias("white"))


@query("caption_files", """WITH f AS (SELECT p_partkey % 50 AS asset, 'clip' || p_partkey::VARCHAR || CASE p_size % 3 WHEN 0 THEN '.vtt' WHEN 1 THEN '.SRT' ELSE '.txt' END AS path, p_size % 3 AS k FROM part) SELECT asset, arg_min(path, row(k, path)) AS path FROM f WHERE k < 2 GROUP BY asset""")
def caption_files(spark, d):
    """The caption file that counts for each asset."""
    ending = F.element_at(F.array(F.lit(".vtt"), F.lit(".SRT"), F.lit(".txt")), (F.col("p_size") % 3 + 1).cast("int"))
    return captions.first_existing(V.table(spark, d, "part").select((F.col("p_partkey") % 50).alias("asset"), F.concat(F.lit("clip"), F.col("p_partkey").cast("string"), ending).alias("path")))


@query("env_values", """WITH l AS (SELECT s_nationkey AS file, s_suppkey AS n, s_suppkey % 7 AS k, s_name AS v FROM supplier), p AS (SELECT file, n, 'KEY' || (n % 4)::VARCHAR AS key, CASE k WHEN 3 THEN 'a=b' ELSE v END AS value FROM l WHERE k NOT IN (0, 1, 2)) SELECT file, key, arg_max(value, n) AS value FROM p GROUP BY ALL""")
def env_values(spark, d):
    """Settings of every file; later lines win."""
    key, v = F.concat(F.lit("KEY"), (F.col("s_suppkey") % 4).cast("string")), F.col("s_name")
    lines = [F.concat(F.lit("# "), key, F.lit("="), v), F.lit("   "), F.lit("no sign"), F.concat(key, F.lit("=a=b")), F.concat(F.lit("  "), key, F.lit(' = "'), v, F.lit('" ')), F.concat(key, F.lit("='"), v, F.lit("'")), F.concat(key, F.lit(" ="), v)]
    s = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("n"), F.element_at(F.array(*lines), (F.col("s_suppkey") % 7 + 1).cast("int")).alias("line"))
    return captions.env_values(s)


@query("project_files", V.ctes("clips") + """ SELECT timeline, count(*) AS clips, min("start") AS first FROM clips GROUP BY timeline""")
def project_files(spark, d):
    """Timelines as project documents of two versions, written and read without their visual context."""
    p = V.clips(spark, d).groupBy("timeline").agg(F.collect_list(F.struct(F.col("clip").alias("id"), "start")).alias("clips"))
    folder = new_folder(spark, "projects")
    p.select((F.col("timeline") % 2 + 1).alias("schemaVersion"), F.col("timeline").cast("string").alias("name"), "clips", F.lit("seen").alias("visualContext")).write.json(folder)
    read = captions.read_projects(spark, folder, (1, 2))
    return read.select(F.col("name").cast("long").alias("timeline"), F.size("clips").cast("long").alias("clips"), F.array_min(F.transform("clips", lambda c: c["start"])).alias("first"))

"""The corpus pipeline: language, exact copies, near copies, mixture, tokens.

Every stage takes the documents that the one before kept, as a written table, and returns
documents again; the last returns each document's encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language_id, minhash_dedup, sentencepiece_codec, source_mixing
from tessera.llm.shared import materialise, table


# How many times the even odds among all languages a text's best language must have.
MIN_ODDS = 1.2


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number of their own for each row, written down, and that column's name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    return docs.join(materialise(gone.select(F.col("row").alias(row)), "gone"), row, "left_anti").drop(row)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell; null texts, those without a letter and those
    for which no language has ``MIN_ODDS`` times the even odds go.

    With no labelled document to learn from, every text with a letter stays."""
    model = language_id.fit_languages(docs.where(~language_id.held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = min(1.0, MIN_ODDS / len(model.languages))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= least)
    return language_id.identify_languages(docs, model).where(known).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id.

    Rows that repeat identifier and text leave one row, whichever of them it is.
    """
    numbered, row = _numbered(docs)
    return _without(numbered, row, exact_dedup.exact_dedup(numbered, row_col=row).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest doc_id, null last.

    Two texts with one doc_id are two documents; rows that repeat identifier and text are one, as the stage
    before leaves none of them.
    """
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ident"), "text")
    near = minhash_dedup.near_duplicates(named, id_col="ident", details=True).where(F.col("component").isNotNull())
    near = materialise(near.select("component", F.struct("doc_id", "uid").alias("one")), "near")
    stays = near.groupBy("component").agg(F.count("*").alias("n"), F.min("one").alias("stays")).where("n > 1").drop("n")
    gone = materialise(near.join(materialise(stays, "stays"), "component").where("one <> stays").select("one.*").distinct(), "gone")
    uid = F.xxhash64(docs["text"].cast("string").cast("binary"))
    here = (F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)) == gone["doc_id"]) & (uid == gone["uid"])
    return docs.join(gone, here, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of the last repetition only the words it takes.

    A cut text ends with the last word that is taken; what stands before is left as it is.
    """
    shares = source_mixing.mix_sources(docs, whole=True).where("taken > 0")
    repeats = shares.select("document", "size", F.explode(F.sequence(F.col("taken"), F.lit(1), -F.col("size"))).alias("left"))
    pieces = F.regexp_extract_all("document.text", F.lit(f"([\\x20\\x09-\\x0D]*{source_mixing.WORD})"))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("left").cast("int")), "")
    text = F.when(F.col("left") < F.col("size"), cut).otherwise(F.col("document.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast("long")
    return repeats.select(*[changed.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_hash and the hash of the decoded text of every document."""
    return sentencepiece_codec.encode_and_decode(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

# Language ID is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage{number}")
    return docs

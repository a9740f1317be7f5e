"""Resampling documents towards a target distribution by hashed n-gram importance weights.

Two Arrow passes over the texts. The first counts hashed features: ``np.bincount`` gives each
partition one vector as long as there are buckets, and ``treeReduce`` merges the vectors. From the
counts of the corpus and of the target follows a gain for each bucket. The second pass gathers the broadcast
gains of a document's features and sums them with ``np.bincount`` weights. Adding Gumbel noise to the
weights and keeping the highest scores draws without replacement in proportion to the importance.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, partition_totals, ranked, table
from tessera.llm.shingles import SLICE, bodies, in_chunks

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

# Runs of more bytes are hashed one by one, all others together, byte after byte.
_SHORT = 64


def _crc_steps() -> np.ndarray:
    """What the reflected polynomial makes of each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_steps()


def crc32_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The crc32 of each span of ``data``."""
    longest_first = np.argsort(-sizes, kind="stable")
    at, size = starts[longest_first], sizes[longest_first]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    n_long = int(np.searchsorted(-size, -_SHORT))
    left = np.searchsorted(-size[n_long:], -np.arange(int(size[n_long:].max(initial=0))), side="left")
    for step, n in enumerate(left.tolist()):  # n spans are longer than step
        here = crc[n_long : n_long + n]
        crc[n_long : n_long + n] = _CRC[(here ^ data[at[n_long : n_long + n] + step]) & np.uint32(255)] ^ (here >> np.uint32(8))
    out = np.empty_like(crc)
    out[longest_first] = ~crc
    for n in longest_first[:n_long].tolist():
        out[n] = zlib.crc32(data[starts[n] : starts[n] + sizes[n]])
    return out


def hashed_runs(texts: list[bytes], low: int, high: int, buckets: int, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of short texts: the bucket of every run of ``low`` to ``high`` words, the text of each, and the words of each text.

    Runs that end within the first ``known`` words are left out.
    """
    joined = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = _IN_WORD[joined]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]  # the last byte is in no word
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    inside[ends] = True  # one separator stays behind each word
    packed = np.where(_IN_WORD[joined], joined, np.uint8(32))[inside]
    sizes = ends - starts
    first = np.cumsum(sizes + 1) - sizes - 1
    hashes, owners = [], []
    for k in range(low, high + 1):
        n = len(first) - k + 1
        if n <= 0:
            continue
        whole = (text[:n] == text[k - 1 :]) & (np.arange(k - 1, len(first)) >= known)
        begin, end = first[:n][whole], (first + sizes)[k - 1 :][whole]
        hashes.append(crc32_spans(packed, begin, end - begin) % np.uint32(buckets))
        owners.append(text[:n][whole])
    words = np.bincount(text[known:], minlength=len(texts))
    none = np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else none).astype(np.int64), np.concatenate(owners) if owners else none, words


def _pieces(text: bytes, overlap: int) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces that end between words, each behind the last ``overlap`` words of those before, and how many these are."""
    at, carried = 0, []
    while at < len(text):
        found = _BREAK.search(text, min(len(text), at + SLICE))
        end = found.start() if found else len(text)
        yield b" ".join([*carried, text[at:end]]), len(carried)
        if overlap:
            carried = [*carried, *(w for w in _BREAK.split(text[at:end]) if w)][-overlap:]
        at = end


def runs_of_batch(column: pa.Array, low: int, high: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """For parts of a column of texts, and slices of long ones: each run's bucket and text, the number of the part's first text, the words of its texts."""
    for at, chunk in in_chunks(bodies(column)):
        if len(chunk) == 1 and len(chunk[0]) > SLICE:
            for piece, known in _pieces(chunk[0], high - 1):
                bucket, owner, words = hashed_runs([piece], low, high, buckets, known)
                yield bucket, owner, at, words
        else:
            bucket, owner, words = hashed_runs(chunk, low, high, buckets)
            yield bucket, owner, at, words


def feature_counts(texts: DataFrame, text_col: str = "text", *, runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for bucket, _, _, _ in runs_of_batch(batch.column("body"), *runs, buckets):
            total += np.bincount(bucket, minlength=buckets)

    return partition_totals(texts.select(F.col(text_col).cast("string").cast("binary").alias("body")), add, buckets)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket 1000 times the logarithm of its share of the target over its share of the corpus, both smoothed by one, rounded down."""
    buckets, all_corpus, all_target = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_corpus + buckets) / ((s + 1.0) * (all_target + buckets)))) for s, t in zip(corpus.tolist(), target.tolist())], np.float64)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    runs: tuple[int, int] = (1, 1),
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    Words are runs of ASCII digits, letters (A-Z lower-cased) and all beyond ASCII; features are all runs of ``runs[0]`` to
    ``runs[1]`` consecutive words, repeats counted. Of the documents with at least ``least_words`` words, ``percent`` in a hundred
    with the highest scores are drawn; ties go to the smaller identifier.

    Nulls: a null text has no features and weight 0; a null identifier is drawn under the name ``null`` and comes first among ties.
    Rows that repeat an identifier are drawn each for itself; only their texts tell them apart, and rows alike in all columns are
    ranked arbitrarily. An empty table gives an empty result, an empty target counts as one without features. Texts may be of any length.
    """
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(feature_counts(docs, text_col, runs=runs, buckets=buckets), feature_counts(target, target_col, runs=runs, buckets=buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = np.zeros((3, batch.num_rows))  # words, features, gains: whole numbers far below 2**53
            for bucket, owner, at, words in runs_of_batch(batch.column("body"), *runs, buckets):
                here = counted[:, at : at + len(words)]
                here[0] += words
                here[1] += np.bincount(owner, minlength=len(words))
                here[2] += np.bincount(owner, weights=gain.value[bucket], minlength=len(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counted.astype(np.int64))], names=["doc_id", "n_words", "n_features", "weight"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    weighed = named.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)
    scored = materialise(weighed, "weights")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    order = ranked(scored.where(enough), F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight"))
    placed = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH step AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS steps
  FROM (SELECT range AS b FROM range(256))),
d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word FROM d),
m AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, hex(word) AS x FROM (SELECT word FROM w UNION SELECT word FROM m)),
h AS (SELECT word,
             xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
                             lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM v, step),
s AS (SELECT bucket, count(*) AS s FROM w JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM m JOIN h USING (word) GROUP BY bucket),
g AS (SELECT h.word, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (st + 10000)::DOUBLE)))::BIGINT AS gain
      FROM h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket),
           (SELECT coalesce(sum(s), 0) AS ss FROM s), (SELECT coalesce(sum(t), 0) AS st FROM t)),
f AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM w JOIN g USING (word) GROUP BY r),
z AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN f USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place FROM z)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM z WHERE n_features >= 20) // 100 THEN place END::BIGINT AS rank
FROM o
"""

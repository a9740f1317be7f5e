"""Vector code compression: product quantization whose codebooks are fitted by Lloyd rounds with Elkan's bounds.

A vector is cut into equal parts, each coded by the nearest entry of its position's codebook. Between
rounds every vector keeps, for each part, an upper bound of the distance to its entry and a lower bound for
every entry, as whole numbers rounded to the safe side. When entries move, the bounds are
shifted by how far; an entry is compared again only if neither its lower bound nor the triangle inequality
says that it is strictly farther than the part's own entry. Comparisons are exact in integers, so ties go to the lower index as in a full comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialise, partition_totals, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Components are held to this size, so that squared distances fit 64 bits.
MOST = 1 << 24
# A lower bound that is cut off at what fits two bytes is still one.
_CAP = np.iinfo(np.uint16).max
# Differences of vectors and entries that are in memory at once.
_CELLS = 1 << 22


def _root_down(square: np.ndarray) -> np.ndarray:
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    return root - (root * root > square)


def _root_up(square: np.ndarray) -> np.ndarray:
    root = _root_down(square)
    return root + (root * root < square)


def _squares(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


def nearest_entries(x: np.ndarray, entries: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the squared distance to its nearest entry, and how many distances were computed for it.

    ``own``, ``upper`` and ``lower`` hold what is known before, and afterwards: the entry, a bound that its distance
    doesn't exceed, and bounds that no entry is nearer than.
    """
    between = _squares(entries[:, None] - entries[None])
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    # own entries whose nearest neighbour is more than twice as far as the part can be stay
    open_rows = np.flatnonzero(between.min(axis=1)[own] <= 4 * upper * upper)
    square = _squares(x - entries[own])
    upper[:] = _root_up(square)
    lower[np.arange(len(x)), own] = np.minimum(_root_down(square), _CAP)
    o = own[open_rows]
    may = (lower[open_rows] <= upper[open_rows, None]) & (between[o] <= 4 * square[open_rows, None])
    at, entry = np.nonzero(may)
    found = _squares(x[open_rows[at]] - entries[entry])
    lower[open_rows[at], entry] = np.minimum(_root_down(found), _CAP)
    all_of = np.full((len(open_rows), len(entries)), np.iinfo(np.int64).max)
    all_of[at, entry] = found
    all_of[np.arange(len(open_rows)), o] = square[open_rows]
    best = all_of.argmin(axis=1)  # the first of equals
    own[open_rows], square[open_rows] = best, all_of[np.arange(len(open_rows)), best]
    upper[open_rows] = _root_up(square[open_rows])
    computed = np.ones(len(x), np.int64)
    computed[open_rows] += may.sum(axis=1)
    return square, computed


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        width = np.diff(np.asarray(vectors.offsets))
        whole = np.clip(np.floor(SCALE * np.asarray(vectors.flatten(), np.float64)), -MOST, MOST).astype(np.int32)
        cuts = np.concatenate([[0], np.cumsum(width)])
        packed = [whole[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["vec_id", "label", "vector"])


def _stacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), kind).reshape(len(column), *shape)


_KNOWN = "vec_id long, label string, vector binary, codes binary, upper binary, lower binary, error long, computed long"


def _assign(rows: DataFrame, entries: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Assign all parts; ``moved`` says how far each entry went since the bounds of ``rows``, None if there are none yet."""
    parts, count, width = entries.shape
    shared = rows.sparkSession.sparkContext.broadcast((entries, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, moved = shared.value
        for whole in batches:
            step = max(1, _CELLS // (count * width))
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                n = batch.num_rows
                x = _stacked(batch.column("vector"), np.int32, parts, width).astype(np.int64)
                if moved is None:
                    own, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts, count), np.int64)
                    upper = np.full((n, parts), 1 << 30)
                else:
                    own = _stacked(batch.column("codes"), np.uint8, parts).astype(np.int64)
                    upper = _stacked(batch.column("upper"), np.int64, parts) + moved[np.arange(parts), own]
                    lower = np.maximum(_stacked(batch.column("lower"), np.uint16, parts, count) - moved, 0)
                error, computed = np.zeros((2, n), np.int64)
                for p in range(parts):
                    square, some = nearest_entries(x[:, p], entries[p], own[:, p], upper[:, p], lower[:, p])
                    error += square
                    computed += some
                pack = lambda a, kind: pa.array([v.tobytes() for v in a.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("vec_id", "label", "vector")], pack(own, np.uint8), pack(upper, np.int64), pack(lower, np.uint16), pa.array(error), pa.array(computed)],
                    names=["vec_id", "label", "vector", "codes", "upper", "lower", "error", "computed"],
                )

    return rows.mapInArrow(run, _KNOWN)


def _means(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries as the rounded-down means of their parts; those without parts stay."""
    parts, count, width = entries.shape
    slots = parts * count

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        codes = _stacked(batch.column("codes"), np.uint8, parts).astype(np.int64)
        slot = (codes + np.arange(parts) * count).ravel()
        total[:slots] += np.bincount(slot, minlength=slots)
        np.add.at(total[slots:].reshape(slots, width), slot, _stacked(batch.column("vector"), np.int32, parts, width).reshape(-1, width))

    totals = partition_totals(rows.select("vector", "codes"), add, slots * (1 + width))
    n, sums = totals[:slots].reshape(parts, count, 1), totals[slots:].reshape(parts, count, width)
    return np.where(n > 0, sums // np.maximum(n, 1), entries)


def fitted_codes(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray | None]:
    """Rows (vec_id, label, codes, error, computed), and the codebooks (part, entry, position), None if there are no rows.

    Components become floor(256 * x). The codebooks start as the parts of the ``entries`` smallest identifiers, are fitted by ``rounds``
    Lloyd rounds and coded once more; an entry is the mean of its parts, rounded down, and stays if it has none. ``error`` is the
    sum of squared distances, ``computed`` the number of distances that the last coding computed, of ``parts * entries``.

    Vectors that are null, hold null or non-finite components, or have not as many components as the first one are left out; so are all if
    that number is not a multiple of ``parts``. Components beyond 2**24 after scaling are held to that. Null identifiers come last, repeated ones are
    ordered by their vectors and take part each for itself. With fewer rows than entries there are fewer entries; the lower of equal entries is used.
    Labels are compared as strings, null is one of them.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    named = named.where(F.col("vector").isNotNull() & F.coalesce(sound, F.lit(False)))
    in_order = [F.col("vec_id").asc_nulls_last(), F.transform("vector", lambda v: F.floor(SCALE * v))]
    first = named.orderBy(*in_order).limit(1).select(F.size("vector").alias("size")).collect()
    size = first[0].size if first else 0
    if not size or size % parts:
        return spark.createDataFrame([], "vec_id long, label string, codes binary, error long, computed long"), None
    named = named.where(F.size("vector") == size)
    start = named.orderBy(*in_order).limit(entries).select("vector").collect()
    book = np.clip(np.floor(SCALE * np.array([r.vector for r in start])), -MOST, MOST).astype(np.int64).reshape(len(start), parts, -1).swapaxes(0, 1)
    rows = materialise(named.mapInArrow(_quantise, "vec_id long, label string, vector binary"), "quantised")
    moved = None
    for _ in range(rounds):
        known = materialise(_assign(rows, book, moved), "bounds")
        discard(rows)
        rows, before = known, book
        book = _means(rows, before)
        moved = _root_up(_squares(book - before))
    coded = materialise(_assign(rows, book, moved).select("vec_id", "label", "codes", "error", "computed"), "codes")
    discard(rows)
    return coded, book


def codebooks_hash(book: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(map(str, [] if book is None else book.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = fitted_codes(table(spark, sf_dir, "embeddings"))
    sums = materialise(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks_hash(book)).alias("codebooks_sha256")
    )


def _coding(n: int) -> str:
    """SQL of the n-th coding and, but for the last one, of the codebooks that follow from it."""
    best = f"""a{n} AS MATERIALIZED (SELECT r, p, any_value(v.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS best
  FROM v JOIN b{n} AS b USING (p) GROUP BY r, p)"""
    if n == ROUNDS:
        return best
    return f"""{best},
m{n} AS (SELECT p, e, list(mean ORDER BY i) AS x FROM (SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS mean FROM a{n}, UNNEST(range(1, len(x) + 1)) AS t(i) GROUP BY ALL) GROUP BY p, e),
b{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{n}.x, b{n}.x) AS x FROM b{n} LEFT JOIN m{n} USING (p, e))"""


ORACLE = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, q) - 1 AS r, vec_id, label, q
  FROM (SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
v AS MATERIALIZED (SELECT r, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS x FROM k, range({PARTS}) AS t(p)),
b0 AS (SELECT p, r AS e, x FROM v WHERE r < {ENTRIES}),
{",\n".join(_coding(n) for n in range(ROUNDS + 1))},
c AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h
"""

"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes, each task's external sort places equal
texts side by side, and a streaming pass compares whole neighbours. The splitters cut on
(leading bytes, hash, identifier), so a group of copies may lie in any number of tasks; the runs
at the edges of tasks are put together by their whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, table

PREFIX_BYTES = 48
_RUN_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("text_sha256", pa.string()),
        ("part", pa.int32()),
        ("run", pa.int64()),
        ("run_size", pa.int64()),
        ("run_keep", pa.int64()),
        ("run_last", pa.bool_()),
        ("edge_body", pa.binary()),
    ]
)
_RUNS = "doc_id long, row long, text_sha256 string, part int, run long, run_size long, run_keep long, run_last boolean, edge_body binary"
_FLUSH_ROWS = 8192


def _run_rows(body: bytes, members: list[tuple[int | None, int | None]], part: int, run: int, edge: bool, keep: str) -> Iterator[tuple]:
    """The rows of one run; its identifiers ascend with nulls first, so the row that stays is the last
    one, or the first that is not null."""
    known = [i for i, _ in members if i is not None]
    stays = None if not known else (known[-1] if keep == "largest" else known[0])
    at = len(members) - 1 if keep == "largest" or not known else len(members) - len(known)
    sha = hashlib.sha256(body).hexdigest()
    for n, (i, row) in enumerate(members):
        yield i, row, sha, part, run, len(members), stays, n == at, body if edge and n == 0 else None


def _compare_neighbours(keep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn sorted rows into rows that know their run of equal bodies.

    The runs that another task may have too are those of its first and last sort key (lead, hash); with
    equal hashes of unequal bodies one key has several runs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        first, key, run = None, None, 0
        runs: list[tuple[bytes, list]] = []  # of the present key

        def close(edge: bool) -> None:
            nonlocal run
            for body, members in runs:
                rows.extend(_run_rows(body, members, part, run, edge, keep))
                run += 1
            runs.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RUN_SCHEMA.types)], schema=_RUN_SCHEMA)
            rows.clear()
            return batch

        for batch in batches:
            ids, numbers, hashes, leads = (batch.column(c).to_pylist() for c in ("doc_id", "row", "hash", "lead"))
            for n, body in enumerate(batch.column("body")):
                body = body.as_py()
                if (leads[n], hashes[n]) != key:
                    close(edge=key == first)
                    key = leads[n], hashes[n]
                    first = first or key
                    if len(rows) >= _FLUSH_ROWS:
                        yield flush()
                if not runs or runs[-1][0] != body:
                    runs.append((body, []))
                runs[-1][1].append((ids[n], numbers[n]))
        close(edge=True)
        if rows:
            yield flush()

    return compare


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "largest",
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column before it is compared (none: texts are equal when
    identical). ``keep`` is ``largest`` or ``smallest``: the row with that identifier stays.

    Nulls: a null text is the empty text; a null identifier loses against any other, and a
    group of null identifiers has keep_id null and one kept row. Of rows that repeat the
    identifier that stays, exactly one is kept. An empty table gives an empty result.
    Columns other than those named are ignored. With ``row_col`` the result has that column's
    number of each row as ``row``.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = (normalise(text) if normalise else text).cast("binary")
    number = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), number.alias("row"), body.alias("body")).select(
        "*", F.substring("body", 1, PREFIX_BYTES).alias("lead"), F.xxhash64("body").alias("hash")
    )
    order = ["lead", "hash", "body", "doc_id"]
    in_order = keyed.repartitionByRange("lead", "hash", "doc_id").sortWithinPartitions(*order)
    runs = materialise(in_order.mapInArrow(_compare_neighbours(keep), _RUNS), "runs")

    # A few runs of each task are at its edges; those that another task has too are put together.
    edges = runs.where(F.col("edge_body").isNotNull()).select("part", "run", "run_size", "run_keep", "edge_body")
    best = F.max if keep == "largest" else F.min
    whole = edges.groupBy("edge_body").agg(
        F.count("*").alias("n"),
        F.sum("run_size").alias("all_size"),
        best("run_keep").alias("all_keep"),
        F.max_by("part", F.struct(F.col("run_keep").isNotNull(), F.col("run_keep") * (1 if keep == "largest" else -1), "part")).alias("keep_part"),
    )
    fix = materialise(edges.join(whole.where("n > 1"), "edge_body").select("part", "run", "all_size", "all_keep", "keep_part"), "fix")
    joined = runs.join(fix, ["part", "run"], "left")
    out = joined.select(
        "doc_id",
        F.coalesce("all_keep", "run_keep").alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("run_last") & F.coalesce(F.col("part") == F.col("keep_part"), F.lit(True))).alias("kept"),
        "text_sha256",
        "row",
    )
    return out if row_col else out.drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

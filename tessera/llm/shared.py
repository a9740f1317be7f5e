"""What the operators share: the folder that all executors see, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
TREE_DEPTH = 3


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a folder of its own; a cluster without
    it is refused, since a driver-local folder would not be seen by executors.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands at most ``ARROW_ROWS`` rows and about ``ARROW_BYTES`` bytes to Python
    at once, since texts can be long. Smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. The table's
    size is known to the planner afterwards, so it broadcasts only what is small.
    """
    path = new_path(df.sparkSession, name)
    bounded_batches(df.sparkSession)
    df.write.parquet(path, compression="zstd")
    return _at(df.sparkSession.read.schema(df.schema).parquet(path), path)


def _at(df: DataFrame, path: str) -> DataFrame:
    df._tessera_path = path
    return df


def same_table(df: DataFrame, of: DataFrame) -> DataFrame:
    """``df``, a projection of a materialised table, known to stand on its files."""
    return _at(df, of._tessera_path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more: what was made of them is written down itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partition_totals(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], length: int) -> np.ndarray:
    """The sum over all partitions of one vector of ``length`` whole numbers each, to which ``add`` adds every batch.

    The vectors meet pair by pair in tasks, a tree of ``TREE_DEPTH`` levels, so the driver gets only a few.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    bounded_batches(df.sparkSession)
    vectors = df.mapInArrow(one, "total binary").rdd.mapPartitions(lambda rows: [sum((np.frombuffer(r.total, np.int64) for r in rows), start=np.zeros(length, np.int64))])
    return vectors.treeReduce(np.add, TREE_DEPTH) if vectors.getNumPartitions() else np.zeros(length, np.int64)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank``, 1 for the first row of the order. Rows are range-partitioned and sorted, so no task holds
    more than its range; only the number of rows of each range passes through one task."""
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "in_order")
    part = F.shiftright("place", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(sizes.select("part", ahead.alias("ahead")), "starts")
    return rows.join(starts, part == F.col("part")).withColumn("rank", F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).drop("place", "part", "ahead")

"""Exact search for the most similar vectors, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS, DATA_ROWS = 512, 2048


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows in blocks of at most ``size``, each as one row of identifiers and packed vectors; cut within a task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_pydict({f"{key}s": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), f"{key}_v": pa.array([part.column(1).to_pylist()], pa.list_(pa.list_(pa.float32())))})

    return rows.mapInArrow(pack, f"{key}s array<bigint>, {key}_v array<array<float>>")


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
    return np.round(q @ v.T / (norms + 1e-6), 6)


def block_top_k(queries: DataFrame, data: DataFrame, *, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the ``k`` largest cosines of each query, rounded to six places; of equal
    scores the smaller identifiers. Vectors of another length score 0, null ones are not compared.

    Each task keeps ``k`` rows of a query for each block of data before the ranking over all blocks.
    """
    base = _blocks(data.where("embedding is not null"), "vec_id", DATA_ROWS)
    asked = _blocks(queries.where("embedding is not null"), "query_id", QUERY_ROWS)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for q_ids, q_v, v_ids, v_v in zip(frame["query_ids"], frame["query_id_v"], frame["vec_ids"], frame["vec_id_v"]):
                ids, by_length = np.asarray(v_ids), {}
                for n, v in enumerate(v_v):
                    by_length.setdefault(len(v), []).append(n)
                score = np.zeros((len(q_ids), len(ids)))
                sizes = np.array([len(v) for v in q_v])
                for length, at in by_length.items():
                    same = np.flatnonzero(sizes == length)
                    if len(same) and length:
                        q = np.stack([q_v[n] for n in same]).astype(float)
                        score[np.ix_(same, at)] = _scores(q, np.stack([v_v[n] for n in at]).astype(float))
                best = np.stack([np.lexsort((ids, -row))[:k] for row in score])
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(q_ids), best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    pairs = base.crossJoin(asked).select("query_ids", "query_id_v", "vec_ids", "vec_id_v")
    found = pairs.mapInPandas(search, "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("n") <= k).drop("n")

"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hop_windows(samples: DataFrame, *, length: str = "500 milliseconds", hop: str = "250 milliseconds", late: str = "1 second") -> DataFrame:
    """Mean and count of samples (src, ts, value) over sliding windows; rows later than ``late`` are dropped."""
    w = F.window("ts", length, hop)
    return samples.withWatermark("ts", late).groupBy("src", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("value")).select("src", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def sessions(samples: DataFrame, *, gap: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Runs of samples of a source without a gap."""
    w = F.session_window("ts", gap)
    return samples.withWatermark("ts", late).groupBy("src", w.alias("w")).agg(F.count("*").alias("n")).select("src", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _throttle(gap: float):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        kept = []
        for t, name in zip(rows["t"], rows["id"]):
            if last is None or t - last >= gap:
                kept.append((key[0], t, name))
                last = t
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame(kept, columns=["src", "t", "id"])

    return step


def throttle(rows: DataFrame, gap: float) -> DataFrame:
    """Rows (src, t, id) at least ``gap`` after the last one that passed, remembered between batches."""
    return rows.groupBy("src").applyInPandasWithState(_throttle(gap), "src long, t double, id long", "last double", "append", GroupStateTimeout.NoTimeout)


def _accumulate(weight: float):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        acc = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        out = []
        for name, value in zip(rows["id"], rows["value"]):
            acc = value if acc is None else acc * (1 - weight) + value * weight
            out.append((key[0], name, acc))
        if acc is not None:
            state.update((float(acc),))
        yield pd.DataFrame(out, columns=["src", "id", "acc"])

    return step


def accumulate(rows: DataFrame, weight: float) -> DataFrame:
    """The moving average of (src, t, id, value), remembered between batches."""
    return rows.groupBy("src").applyInPandasWithState(_accumulate(weight), "src long, id long, acc double", "acc double", "append", GroupStateTimeout.NoTimeout)

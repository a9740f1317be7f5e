"""Ordered folds as streams: rows may come late and out of order, results equal those of the batch queries.

A source's rows are held in a list state until the watermark has passed them, when no earlier row can come any more. A timer at the
earliest held row hands them on in order to a fold, whose state is kept in value and map states. Only what the allowed lateness spans is
held, never a source. Rows later than that are dropped by Spark.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.folds import sticky_step
from tessera.operators.masks import mask_step
from tessera.sources.scratch import new_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands a source's rows (us, id, ...) to ``fold`` once and in order; subclasses keep states of their own.

    Every use of a state is a call to the JVM, so rows are held as arrays, many to an element, and a fold gets all rows that are ready at once."""

    #: Fixed for each kind: the columns after us and id, and the result.
    columns = ""
    result = ""
    #: Rows of an element of the list of held rows.
    together = 10_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        types = [c.split(maxsplit=1) for c in ("us long", "id long", *self.columns.split(", "))]
        self.names = [name for name, _ in types]
        self.held = handle.getListState("held", ", ".join(f"{name} array<{kind}>" for name, kind in types))
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """Results of the next rows in order; reads states before the first and writes them after the last."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held = None, []
        for frame in rows:
            held += self._packed([[self._plain(v) for v in frame[c].tolist()] for c in self.names])
            first = min(int(frame["us"].min()), first if first is not None else int(frame["us"].min()))
        if first is not None:
            self.held.appendList(held)
            self.handle.registerTimer(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed, not only what the timer was set for; the rest gets the next timer."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((r for some in self.held.get() for r in zip(*some)), key=lambda r: r[:2]) if self.held.exists() else []
        ready = held[: bisect_right(held, passed, key=lambda r: r[0])]
        rest = held[len(ready) :]
        if rest:
            self.held.put(self._packed([list(c) for c in zip(*rest)]))
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.held.clear()
        made = self.fold(key, ready) if ready else []
        if made:
            yield pd.DataFrame(made, columns=[c.split()[0] for c in self.result.split(", ")])

    def _packed(self, columns: list[list]) -> list[tuple]:
        return [tuple(c[at : at + self.together] for c in columns) for at in range(0, len(columns[0]), self.together)]

    @staticmethod
    def _plain(value):
        return value.tolist() if isinstance(value, np.ndarray | np.generic) else None if value is pd.NaT or value is None or value is pd.NA else value

    def close(self) -> None:
        pass


class Deltas(InOrder):
    """The distance in microseconds of each frame to the one before it, and how many frames came after a later one."""

    columns, result = "arrived long", "src long, id long, delta long, overtaken long"

    def begin(self, handle):
        self.last = handle.getValueState("last", "us long, arrived long, overtaken long")

    def fold(self, key, rows):
        last, made = tuple(self.last.get()) if self.last.exists() else None, []
        for us, name, arrived in rows:
            before, latest, overtaken = last or (None, arrived, 0)
            overtaken += arrived < latest
            last = us, max(arrived, latest), overtaken
            made.append((key[0], name, None if before is None else us - before, overtaken))
        self.last.update(last)
        return made


class Speakers(InOrder):
    """The speaker goes on until another is clearly better or it is absent."""

    columns, result = "tracks array<string>, scores array<double>", "src long, word_id long, track string"

    def begin(self, handle):
        self.last = handle.getValueState("last", "track string")

    def fold(self, key, rows):
        track, made = self.last.get()[0] if self.last.exists() else None, []
        for _, word, tracks, scores in rows:
            track = sticky_step(track, tracks, scores)
            made.append((key[0], word, track))
        self.last.update((track,))
        return made


class Tracks(InOrder):
    """Number of tracks of each sample, whether none of the last ones is among them, and how long ago the longest missing one was seen.

    A map holds when each track was seen last; those not seen for ``forget`` microseconds are forgotten, so it doesn't grow with a source."""

    columns, result = "tracks array<string>", "src long, id long, n long, reacquired boolean, missing long"

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def begin(self, handle):
        self.seen = handle.getMapState("seen", "track string", "us long, id long")
        self.last = handle.getValueState("last", "us long, id long")

    def fold(self, key, rows):
        had = {k[0]: tuple(v) for k, v in self.seen.iterator()} if self.seen.exists() else {}
        last_had = tuple(self.last.get()) if self.last.exists() else None
        seen, last, made = dict(had), last_had, []
        for us, name, tracks in rows:
            tracks = set(tracks or ())
            of_last = {t for t, at in seen.items() if at == last}
            missing = [us - at for t, (at, _) in seen.items() if t not in tracks]
            seen = {t: at for t, at in seen.items() if t in tracks or us - at[0] <= self.forget or t in of_last}
            seen.update(dict.fromkeys(tracks, (us, name)))
            if tracks:
                last = us, name
            again = bool(tracks and of_last and not tracks & of_last)
            made.append((key[0], name, len(tracks), again, max(missing) if missing else None))
        for t in had.keys() - seen.keys():
            self.seen.removeKey((t,))
        for t, at in seen.items():
            if had.get(t) != at:
                self.seen.updateValue((t,), at)
        if last != last_had:
            self.last.update(last)
        return made


class Masks(InOrder):
    """Key frames take their own mask, the others the last one moved along the flow."""

    columns = "own array<int>, dx array<int>, dy array<int>"
    result = "src long, key long, mask string, coverage double, delta double, stability double, score double"

    def __init__(self, every: int) -> None:
        self.every = every

    def begin(self, handle):
        self.last = handle.getValueState("last", "mask array<boolean>, coverage double")

    def fold(self, key, rows):
        last, made = None, []
        if self.last.exists():
            mask, coverage = self.last.get()
            last = np.asarray(mask, bool).reshape(8, 8), coverage
        for _, name, own, dx, dy in rows:
            last, row = mask_step(last, name, own, dx, dy, self.every)
            made.append((key[0], *row))
        mask, coverage = last
        self.last.update((mask.ravel().tolist(), coverage))
        return made


def in_order(rows: DataFrame, processor: InOrder, *, id_col: str = "id", late: str = "10 seconds") -> DataFrame:
    """The stream (src, ts, id, ...) through a processor; ``late`` is how much later than the newest row one may come."""
    names = [c.split()[0] for c in processor.columns.split(", ")]
    timed = rows.withWatermark("ts", late).select("src", "ts", F.unix_micros("ts").alias("us"), F.col(id_col).alias("id"), *names)
    return timed.groupBy("src").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.result, outputMode="Append", timeMode="EventTime")


def deltas(frames: DataFrame, **options) -> DataFrame:
    return in_order(frames, Deltas(), **options)


def speakers(words: DataFrame, **options) -> DataFrame:
    return in_order(words, Speakers(), **options)


def tracks(samples: DataFrame, *, forget_seconds: float = 3600.0, **options) -> DataFrame:
    return in_order(samples, Tracks(int(forget_seconds * 1e6)), **options)


def masks(frames: DataFrame, *, every: int = 8, **options) -> DataFrame:
    return in_order(frames, Masks(every), **options)


@contextmanager
def rocks(spark: SparkSession):
    """Such states need this store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def drained(spark: SparkSession, stream: Callable[[], DataFrame], name: str) -> DataFrame:
    """Run a stream over all that its source holds now, and read what it wrote."""
    folder = new_folder(spark, name)
    with rocks(spark):
        df = stream()
        query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")

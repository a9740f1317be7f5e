"""Operators that depend on the rows before in order: hysteresis, chunking, clustering.

A fold reads each source's rows in order from its sorted task and keeps only its state. Folds whose steps can be composed
are in ``blocks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_fold(rows: DataFrame, *, by: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, list[tuple]]], schema: str, finish: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """For each source ``start()`` gives a state and ``step(state, row)`` the next one and result rows;
    ``finish(state)`` may add rows at a source's end."""
    columns = [part.split()[0] for part in schema.split(", ")]
    names = rows.columns

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, state, begun = None, None, False
        at = names.index(by)
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False, name=None):
                if not begun or row[at] != source:
                    if begun and finish:
                        out += finish(state)
                    source, state, begun = row[at], start(), True
                state, made = step(state, row)
                out += made
            yield pd.DataFrame(out, columns=columns)
        if begun and finish:
            yield pd.DataFrame(finish(state), columns=columns)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(fold, schema)


def sticky_step(last: str | None, tracks: list[str] | None, scores: list[float] | None, factor: float = 1.15, lift: float = 0.005) -> str:
    """The track that speaks after ``last``: it changes only for a clearly better candidate, or when it is absent."""
    found = sorted(zip(scores, tracks), key=lambda x: (-x[0], x[1])) if tracks is not None else [(1.0, "OFFSCREEN")]
    of = {t: s for s, t in found}
    best = found[0]
    return last if last in of and best[0] < of[last] * factor + lift else best[1]


def sticky_speaker(candidates: DataFrame, *, factor: float = 1.15, lift: float = 0.005, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (src, word_id, tracks, scores) to (src, word_id, track) and the columns to ``keep`` in the order of words; without candidates it is OFFSCREEN."""
    own = candidates.select("src", "word_id", "tracks", "scores", *keep)
    kept = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in keep)

    def step(last, row):
        src, word, tracks, scores, *rest = row
        track = sticky_step(last, tracks, scores, factor, lift)
        return track, [(src, word, track, *rest)]

    return ordered_fold(own, by="src", order=["word_id"], start=lambda: None, step=step, schema="src long, word_id long, track string" + kept)


def caption_chunks(words: DataFrame, *, seconds: float = 4.0, most: int = 12, gap: float = 0.8) -> DataFrame:
    """Words (src, start, end, word, speaker) to cues: a cue ends at its length, word count, a gap, a sentence end or another speaker."""
    own = words.select("src", "start", "end", "word", "speaker")

    def cue(state):
        src, rows = state
        return [(src, rows[0][0], rows[-1][1], " ".join(r[2] for r in rows), rows[0][3])] if rows else []

    def step(state, row):
        src, start, end, word, speaker = row
        _, rows = state
        cut = rows and (end - rows[0][0] >= seconds or len(rows) >= most or start - rows[-1][1] >= gap or speaker != rows[0][3])
        out = cue(state) if cut else []
        rows = [(start, end, word, speaker)] if cut else [*rows, (start, end, word, speaker)]
        if word[-1:] in ".!?":
            return (src, []), out + cue((src, rows))
        return (src, rows), out

    return ordered_fold(own, by="src", order=["start", "end", "word"], start=lambda: (None, []), step=step, finish=cue, schema="src long, start double, end double, text string, speaker string")


def normalise_cues(cues: DataFrame) -> DataFrame:
    """Drop broken cues (src, start, end, text, speaker) and let each start no earlier than the last kept one ended.

    A sound cue that reaches beyond all before it is kept, so the last kept end is the greatest end so far."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = cues.where(number("start") & number("end") & (F.col("start") >= 0) & (F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) != ""))
    before = Window.partitionBy("src").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.lit(0.0), F.max(F.when(F.col("end") > F.col("start"), F.col("end"))).over(before))
    return sound.withColumn("start", F.greatest("start", reach)).where("end > start").select("src", "start", "end", "text", "speaker")


class _Centroids:
    """The clusters of one source so far: moving centroids of unit length and how many vectors each has."""

    def __init__(self) -> None:
        self.of, self.sizes = np.zeros((0, 0)), []

    def join(self, vectors: np.ndarray, threshold: float) -> list[int]:
        """The cluster of each vector, from 0. Likeness to all centroids is one product for all vectors, and is renewed for a centroid that moves."""
        v = vectors / np.sqrt(np.maximum(1e-12, (vectors * vectors).sum(axis=1, keepdims=True)))
        had, k = len(self.sizes), len(self.sizes)
        centroids = np.zeros((had + len(v), v.shape[1]))
        like = np.empty((len(v), had + len(v)))
        if had:
            centroids[:had] = self.of
            like[:, :had] = v @ self.of.T
        out = []
        for n, own in enumerate(v):
            best = like[n, :k].max(initial=-np.inf)
            at = k
            if k:
                ties = np.flatnonzero(like[n, :k] >= best - 2e-12)
                ties = ties[np.round(like[n, ties], 12) == np.round(best, 12)]
                near = min(ties.tolist(), key=lambda i: f"C{i + 1}")
                at = near if like[n, near] >= threshold else k
            if at < k:
                c = centroids[at] * self.sizes[at] + own
                centroids[at] = c / np.sqrt(max(1e-12, float(c @ c)))
                self.sizes[at] += 1
            else:
                centroids[k] = own
                self.sizes.append(1)
                k += 1
            like[n + 1 :, at] = v[n + 1 :] @ centroids[at]
            out.append(at)
        self.of = centroids[:k].copy()
        return out


#: Numbers of the table of likeness between vectors and centroids.
LIKE_AT_ONCE = 1 << 22


def online_clusters(vectors: DataFrame, *, threshold: float = 0.72, order: tuple[str, ...] = ("key",)) -> DataFrame:
    """Vectors (src, key, vector) in ``order`` join the most similar centroid of at least ``threshold``, else
    found a cluster; centroids stay of unit length and equal similarities go to the smaller name."""
    own = vectors.select("src", "key", "vector", *(c for c in order if c != "key"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, state = None, _Centroids()
        for frame in frames:
            names: list[int] = []
            for src, rows in frame.groupby("src", sort=False, dropna=False):
                if src != source:
                    source, state = src, _Centroids()
                v = np.stack(rows["vector"].to_list()).astype(float)
                begin = 0
                while begin < len(v):
                    some = max(1, min(1024, LIKE_AT_ONCE // (len(state.sizes) + 1024)))
                    names += state.join(v[begin : begin + some], threshold)
                    begin += some
            yield pd.DataFrame({"src": frame["src"], "key": frame["key"], "cluster": [f"C{n + 1}" for n in names]})

    return own.repartition("src").sortWithinPartitions("src", *order).mapInPandas(fold, "src long, key long, cluster string")


def one_to_one(bindings: DataFrame, *, least: float = 0.7) -> DataFrame:
    """Edges (src, speaker, track, posterior), best first, each speaker and track used once."""
    own = bindings.where(f"posterior >= {least}").selectExpr("src", "-posterior as rank", "speaker", "track")

    def step(used, row):
        src, rank, speaker, track = row
        if ("s", speaker) in used or ("t", track) in used:
            return used, []
        used.update((("s", speaker), ("t", track)))
        return used, [(src, speaker, track, -rank)]

    return ordered_fold(own, by="src", order=["rank", "speaker", "track"], start=set, step=step, schema="src long, speaker string, track string, posterior double")

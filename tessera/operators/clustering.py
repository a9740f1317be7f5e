"""Speakers from sound: clustering of voice windows and the repairs that follow.

Clusters of a source are merged pair by pair while it has at most ``MOST_WINDOWS`` windows; longer sources are
clustered as a stream with moving centroids, so no task holds one without bound. Which of the two a source gets, and by
what number, is the reference's rule (``AudioSpeakerClusterer.cluster``) and part of the result. Repairs work on one row
for each cluster; each cluster keeps its next partner, so a merge compares only what it changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import LIKE_AT_ONCE, online_clusters, ordered_fold

MOST_WINDOWS = 256


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.maximum(1e-12, (v * v).sum(axis=-1, keepdims=True)))


def merge_pairs(vectors: np.ndarray, mids: np.ndarray, threshold: float) -> list[int]:
    """The number of each window's cluster, from 1 by first appearance.

    The most alike pair of centroids is merged until none reaches ``threshold``; equal likeness goes to the pair that
    begins earlier, then to the one that stands earlier in the list, where merged clusters go to the end."""
    centroids, sizes, firsts = list(unit(np.asarray(vectors, float))), [1] * len(vectors), list(map(float, mids))
    members = [[n] for n in range(len(vectors))]
    while len(members) > 1:
        c = np.stack(centroids)
        likeness = np.triu(np.round(c @ c.T, 12) + 2, 1) - 2
        best = likeness.max()
        if best < threshold:
            break
        pairs = np.argwhere(likeness == best)
        i, j = min(pairs.tolist(), key=lambda p: (min(firsts[p[0]], firsts[p[1]]), p))
        merged = unit(centroids[i] * sizes[i] + centroids[j] * sizes[j])
        new = (merged, sizes[i] + sizes[j], min(firsts[i], firsts[j]), members[i] + members[j])
        for kept, value in zip((centroids, sizes, firsts, members), new):
            del kept[j], kept[i]
            kept.append(value)
    out = [0] * len(vectors)
    for rank, n in enumerate(sorted(range(len(members)), key=lambda n: (firsts[n], n))):
        for m in members[n]:
            out[m] = rank + 1
    return out


def clusters(windows: DataFrame, *, threshold: float = 0.72) -> DataFrame:
    """Windows (src, key, mid, vector) to (src, key, cluster), taken by ``mid`` either way."""
    counts = windows.groupBy("src").agg(F.count("*").alias("n"))
    few, many = (windows.join(counts.where(cond).select("src"), "src", "left_semi") for cond in (F.col("n") <= MOST_WINDOWS, F.col("n") > MOST_WINDOWS))

    def pairwise(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["mid", "key"])
        names = merge_pairs(np.stack(frame["vector"]), frame["mid"].to_numpy(), threshold)
        return pd.DataFrame({"src": frame["src"], "key": frame["key"], "cluster": [f"C{n}" for n in names]})

    short = few.groupBy("src").applyInPandas(pairwise, "src long, key long, cluster string")
    return short.unionByName(online_clusters(many, threshold=threshold, order=("mid", "key")))


def cluster_sums(windows: DataFrame, assigned: DataFrame) -> DataFrame:
    """(src, cluster, n, first_mid, total): each cluster's sum of unit vectors, laid out by dimension."""
    long = windows.join(assigned, ["src", "key"]).select("src", "cluster", "mid", F.expr("sqrt(greatest(1e-12D, aggregate(vector, 0D, (s, x) -> s + x * x)))").alias("length"), F.posexplode("vector").alias("k", "x"))
    by_dimension = long.groupBy("src", "cluster", "k").agg(F.sum(F.col("x") / F.col("length")).alias("x"), F.count("*").alias("n"), F.min("mid").alias("first_mid"))
    return by_dimension.groupBy("src", "cluster").agg(F.max("n").alias("n"), F.min("first_mid").alias("first_mid"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("total"))


class _Alike:
    """The clusters of one source in the order of their names; likeness of unit sums is computed a bounded block of pairs at a time."""

    def __init__(self, frame: pd.DataFrame) -> None:
        frame = frame.sort_values("cluster", kind="stable")
        self.names = frame["cluster"].tolist()
        self.sums = np.stack(frame["total"].to_list()).astype(float)
        self.units, self.alive = unit(self.sums), np.ones(len(frame), bool)
        self.sizes, self.firsts = frame["n"].to_numpy(np.int64).copy(), frame["first_mid"].to_numpy(float).copy()

    def blocks(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some rows at a time, with their likeness to all clusters; to itself and to those that are gone it is -inf."""
        some = max(1, LIKE_AT_ONCE // len(self.names))
        for at in range(0, len(rows), some):
            part = rows[at : at + some]
            like = self.units[part] @ self.units.T
            like[:, ~self.alive] = -np.inf
            like[np.arange(len(part)), part] = -np.inf
            yield part, like

    def merge(self, to: int, gone: int) -> None:
        self.sums[to] += self.sums[gone]
        self.units[to] = unit(self.sums[to])
        self.sizes[to] += self.sizes[gone]
        self.alive[gone] = False


def _per_source(sums: DataFrame, merge: Callable[[_Alike], dict[int, int]]) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state = _Alike(frame)
        roots = {state.names[c]: state.names[r] for c, r in _roots(merge(state)).items()}
        return pd.DataFrame({"src": frame["src"], "cluster": frame["cluster"], "into": [roots.get(c, c) for c in frame["cluster"]]})

    return sums.groupBy("src").applyInPandas(run, "src long, cluster string, into string")


def _roots(into: dict[int, int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for c in reversed(into):  # what a cluster joins goes later, if at all
        out[c] = out.get(into[c], into[c])
    return out


def absorb_small(sums: DataFrame, *, threshold: float, short_windows: bool = True) -> DataFrame:
    """(src, cluster, into): a small cluster joins one like it, the smaller the larger; after each merge from the start."""
    share, least, slack = (0.5, 4, 0.05) if short_windows else (0.2, 2, 0.1)

    def merge(state: _Alike) -> dict[int, int]:
        total = int(state.sizes.sum())
        if total < 3:
            return {}
        small, enough = max(least, int(np.floor(total * share + 0.5))), max(0.0, threshold - slack)
        k = len(state.names)
        partner = np.full(k, k)  # the first cluster behind each that it would merge with; k for none

        def fits(rows: np.ndarray, like: np.ndarray) -> np.ndarray:
            near = like >= enough - 1e-11
            near[near] = np.round(like[near], 12) >= enough
            return near & ((state.sizes[rows] <= small)[:, None] | (state.sizes <= small))

        def search(rows: np.ndarray) -> None:
            for part, like in state.blocks(rows):
                ok = fits(part, like) & (np.arange(k) > part[:, None])
                partner[part] = np.where(ok.any(axis=1), ok.argmax(axis=1), k)

        search(np.arange(k))
        into: dict[int, int] = {}
        while (i := int((partner < k).argmax())) < k and partner[i] < k:
            j = int(partner[i])
            to, gone = (i, j) if state.sizes[i] >= state.sizes[j] else (j, i)
            into[gone] = to
            state.merge(to, gone)
            partner[gone] = k
            search(np.flatnonzero(state.alive & ((partner == to) | (partner == gone) | (np.arange(k) == to))))
            rows, like = next(state.blocks(np.array([to])))
            ok = fits(rows, like)[0] & (np.arange(k) < to)
            partner[ok] = np.minimum(partner[ok], to)
        return into

    return _per_source(sums, merge)


def collapse_alike(sums: DataFrame, *, threshold: float = 0.88) -> DataFrame:
    """(src, cluster, into): while a source has three clusters, the most alike pair of at least ``threshold`` becomes
    the one that begins earlier."""

    def merge(state: _Alike) -> dict[int, int]:
        k = len(state.names)
        partner, likeness = np.full(k, -1), np.full(k, -np.inf)  # each cluster's best, if that is alike enough

        def key(i: int, j: int) -> tuple:
            return min(state.firsts[i], state.firsts[j]), min(i, j), max(i, j)

        def search(rows: np.ndarray) -> None:
            for part, like in state.blocks(rows):
                partner[part], likeness[part] = -1, -np.inf
                best = np.round(like.max(axis=1), 12)
                for at in np.flatnonzero(best >= threshold):
                    i = int(part[at])
                    ties = np.flatnonzero(like[at] >= best[at] - 2e-12)
                    ties = ties[np.round(like[at, ties], 12) == best[at]]
                    partner[i], likeness[i] = min(ties.tolist(), key=lambda j: key(i, j)), best[at]

        search(np.arange(k))
        into: dict[int, int] = {}
        left = k
        while left >= 3 and (best := likeness.max()) >= threshold:
            a, b = min((key(i, int(partner[i])) for i in np.flatnonzero(likeness == best).tolist()))[1:]
            to, gone = (a, b) if (state.firsts[a], a) <= (state.firsts[b], b) else (b, a)
            into[gone] = to
            state.merge(to, gone)
            state.firsts[to] = min(state.firsts[a], state.firsts[b])
            left -= 1
            partner[gone], likeness[gone] = -1, -np.inf
            search(np.flatnonzero(state.alive & ((partner == to) | (partner == gone) | (np.arange(k) == to))))
            _, like = next(state.blocks(np.array([to])))
            now = np.round(like[0], 12)
            for i in np.flatnonzero((now >= threshold) & (now >= likeness)).tolist():
                if now[i] > likeness[i] or key(i, to) < key(i, int(partner[i])):
                    partner[i], likeness[i] = to, now[i]
        return into

    return _per_source(sums, merge)


def reassign_rare(words: DataFrame) -> DataFrame:
    """Words (src, i, speaker) numbered by i to (src, i, speaker): with five speakers or more, those of at most 3% of a
    source's words, or two, give them to the speaker nearest by number, the left one on a tie.

    Words are taken in order, so a word given away counts for those behind it. Without any other speaker it is OFFSCREEN.
    """
    known = words.where("speaker is not null and speaker <> 'OFFSCREEN'").groupBy("src", "speaker").agg(F.count("*").alias("n"))
    by = Window.partitionBy("src")
    rare = known.withColumns({"kinds": F.count("*").over(by), "total": F.sum("n").over(by)})
    rare = rare.where((F.col("kinds") >= 5) & (F.col("n") <= F.greatest(F.lit(2), F.ceil(F.col("total") * 0.03)))).select("src", "speaker", F.lit(True).alias("rare"))
    marked = words.join(rare, ["src", "speaker"], "left").withColumn("rare", F.coalesce("rare", F.lit(False)))
    here = F.when(~F.col("rare") & F.col("speaker").isNotNull() & (F.col("speaker") != "OFFSCREEN"), F.struct("i", "speaker"))
    back = by.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    ready = marked.withColumn("next", F.last(here, True).over(back)).select("src", "i", "speaker", "rare", F.col("next.i").alias("next_i"), F.col("next.speaker").alias("next_speaker"))

    def step(last, row):
        src, i, speaker, is_rare, next_i, next_speaker = row
        ahead = None if next_speaker is None else (int(next_i), next_speaker)
        if is_rare:
            left = last if last and (not ahead or i - last[0] <= ahead[0] - i) else None
            speaker = left[1] if left else ahead[1] if ahead else "OFFSCREEN"
        if speaker is not None and speaker != "OFFSCREEN":
            last = (i, speaker)
        return last, [(src, i, speaker)]

    return ordered_fold(ready, by="src", order=["i"], start=lambda: None, step=step, schema="src long, i long, speaker string")


def cluster_speakers(assigned: DataFrame, faces: DataFrame) -> DataFrame:
    """(src, cluster, speaker): clusters stand for themselves, or for the one face track of a source that has no other."""
    tracks = faces.groupBy("src").agg(F.min("track").alias("only"), F.max("track").alias("other"))
    each = assigned.select("src", "cluster").distinct().join(tracks, "src", "left")
    return each.select("src", "cluster", F.when(F.col("only") == F.col("other"), F.col("only")).otherwise(F.col("cluster")).alias("speaker"))

import random

import numpy as np
import pytest

from tessera.operators import clustering as C
from tessera.operators.masks import propagate_masks
from tessera.plans import speaker_queries as Q


def naive(vectors, mids, threshold):
    groups = [[n] for n in range(len(vectors))]
    unit = [v / np.sqrt(v @ v) for v in vectors]
    centre = {(n,): unit[n] for n in range(len(vectors))}
    first = lambda g: min(mids[n] for n in g)
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                s = round(float(centre[tuple(groups[i])] @ centre[tuple(groups[j])]), 12)
                key = (-s, min(first(groups[i]), first(groups[j])), i, j)
                best = key if best is None or key < best else best
        if -best[0] < threshold:
            break
        i, j = best[2:]
        a, b = groups[i], groups[j]
        c = centre[tuple(a)] * len(a) + centre[tuple(b)] * len(b)
        del groups[j], groups[i]
        groups.append(a + b)
        centre[tuple(a + b)] = c / np.sqrt(c @ c)
    groups.sort(key=first)
    return [next(k + 1 for k, g in enumerate(groups) if n in g) for n in range(len(vectors))]


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.9])
def test_pairs_are_merged_as_by_hand(threshold):
    rng = np.random.default_rng(int(threshold * 10))
    v = np.concatenate([rng.normal(size=4) * 3 + rng.normal(size=(8, 4)) for _ in range(3)] + [np.ones((3, 4))])
    mids = rng.permutation(len(v)).astype(float)
    assert C.merge_pairs(v, mids, threshold) == naive(list(v), mids, threshold)


def test_long_sources_are_clustered_as_a_stream(spark):
    rows = [(s, k, float(k), [1.0, float(k % 2) * 5]) for s, n in ((1, 40), (2, 300)) for k in range(n)]
    got = C.clusters(spark.createDataFrame(rows, "src long, key long, mid double, vector array<double>"), threshold=0.9).collect()
    assert {(r.src, r.key, r.cluster) for r in got} == {(s, k, f"C{k % 2 + 1}") for s, k, *_ in rows}


def as_a_stream(vectors, threshold):
    centres, sizes, out = [], [], []
    for v in vectors / np.linalg.norm(vectors, axis=1, keepdims=True):
        best = min(((-round(float(c @ v), 12), f"C{n + 1}", n) for n, c in enumerate(centres)), default=None)
        n = len(centres) if best is None or -best[0] < threshold else best[2]
        if n == len(centres):
            centres.append(v)
            sizes.append(1)
        else:
            moved = centres[n] * sizes[n] + v
            centres[n], sizes[n] = moved / np.linalg.norm(moved), sizes[n] + 1
        out.append(f"C{n + 1}")
    return out


def test_each_side_of_the_rule_takes_windows_by_time(spark):
    """up to 256 windows go pair by pair, more of them as a stream; that stream went by identifier instead of time."""
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for src, n in ((1, 256), (2, 257)):
        v = rng.normal(size=(n, 6))
        mids = rng.permutation(n).astype(float)
        rows += [(src, k, float(mids[k]), v[k].tolist()) for k in range(n)]
        at = np.argsort(mids)
        names = [f"C{c}" for c in C.merge_pairs(v[at], mids[at], 0.7)] if src == 1 else as_a_stream(v[at], 0.7)
        want |= {(src, int(k), name) for k, name in zip(at, names)}
    got = C.clusters(spark.createDataFrame(rows, "src long, key long, mid double, vector array<double>"), threshold=0.7).collect()
    assert {(r.src, r.key, r.cluster) for r in got} == want and len(got) == 513


def sums(spark, rows):
    return spark.createDataFrame(rows, "src long, cluster string, n long, first_mid double, total array<double>")


def test_small_and_alike_clusters(spark):
    rows = [(1, "C1", 10, 0.0, [10.0, 0.0]), (1, "C2", 2, 1.0, [2.0, 0.2]), (1, "C3", 9, 2.0, [0.0, 9.0]), (1, "C4", 1, 3.0, [0.1, 1.0]), (2, "C1", 1, 0.0, [1.0, 0.0]), (2, "C2", 1, 1.0, [1.0, 0.0])]
    got = {(r.src, r.cluster): r.into for r in C.absorb_small(sums(spark, rows), threshold=0.9, short_windows=False).collect()}
    assert got == {(1, "C1"): "C1", (1, "C2"): "C1", (1, "C3"): "C3", (1, "C4"): "C3", (2, "C1"): "C1", (2, "C2"): "C2"}
    got = {(r.src, r.cluster): r.into for r in C.collapse_alike(sums(spark, rows), threshold=0.95).collect()}
    # the pair most alike goes first; with two clusters left a source stays as it is
    assert got == {(1, "C1"): "C1", (1, "C2"): "C1", (1, "C3"): "C3", (1, "C4"): "C3", (2, "C1"): "C1", (2, "C2"): "C2"}


def test_rare_speakers_by_hand(spark):
    rng = random.Random(3)
    rows = []
    for src in (1, 2):
        for i in range(1, 160):
            rows.append((src, i, rng.choices([None, "OFFSCREEN", "A", "B", "C", "D", "R1", "R2"], [2, 2, 9, 9, 9, 9, 0.4, 0.4])[0] if src == 1 else rng.choice(["A", "R1"])))
    want = {}
    for src in (1, 2):
        own = [s for x, _, s in rows if x == src]
        known = [s for s in own if s not in (None, "OFFSCREEN")]
        few = max(2, -(-len(known) * 3 // 100))
        rare = {s for s in set(known) if known.count(s) <= few} if len(set(known)) >= 5 else set()
        good = lambda s: s not in (None, "OFFSCREEN") and s not in rare
        for i, s in enumerate(own):
            if s in rare:
                near = [own[j] for step in range(1, len(own)) for j in (i - step, i + step) if 0 <= j < len(own) and good(own[j])]
                own[i] = near[0] if near else "OFFSCREEN"
        want |= {(src, i + 1): s for i, s in enumerate(own)}
    got = C.reassign_rare(spark.createDataFrame(rows, "src long, i long, speaker string").repartition(3)).collect()
    assert {(r.src, r.i): r.speaker for r in got} == want


def test_masks_move_between_key_frames(spark):
    square = [int(y in (2, 3) and x in (2, 3)) for y in range(8) for x in range(8)]
    rows = [(1, k, square, [1] * 64, [0] * 64) for k in range(8)]
    got = {r.key: r for r in propagate_masks(spark.createDataFrame(rows, "src long, key long, own array<int>, dx array<int>, dy array<int>"), every=4).collect()}
    at = lambda k: {(n // 8, n % 8) for n, c in enumerate(got[k].mask) if c == "1"}
    assert at(0) == at(4) == {(y, x) for y in (2, 3) for x in (2, 3)}
    assert at(3) == {(y, x) for y in (2, 3) for x in (5, 6)}
    assert got[1].stability == pytest.approx(2 / 6) and got[0].stability is None and got[1].score == pytest.approx(3 * 4 / 64)


def test_many_clusters_are_merged_in_time(spark):
    """Two thousand clusters hardly alike, as pairs of random vectors: comparing all pairs anew after each merge would take hours."""
    import time

    rng = np.random.default_rng(5)
    half = rng.normal(size=(1000, 64))
    both = np.concatenate([half, half + rng.normal(size=half.shape) * 0.1])
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    rows = [(1, f"C{n + 1}", 1, float(n), v.tolist()) for n, v in enumerate(unit)]
    begun = time.time()
    got = {r.cluster: r.into for r in C.collapse_alike(sums(spark, rows), threshold=0.9).collect()}
    assert all(got[f"C{n + 1}"] == got[f"C{n + 1001}"] == f"C{n + 1}" for n in range(1000))
    got = {r.cluster: r.into for r in C.absorb_small(sums(spark, rows), threshold=0.95).collect()}
    assert all(got[f"C{n + 1}"] == got[f"C{n + 1001}"] for n in range(1000)) and len(set(got.values())) == 1000
    assert time.time() - begun < 60


def test_diarization_reads_words_once_for_each_side(spark, tmp_path):
    """the words and their candidates were made twice, and words that share an identifier were multiplied."""
    from tessera.plans import fold_queries, temporal_queries

    data = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    turns.union(turns).write.parquet(f"{tmp_path}/conversations.parquet")
    (tmp_path / "events.parquet").symlink_to(f"{data}/events.parquet")
    found = fold_queries.speaker_diarization(spark, str(tmp_path))
    words = temporal_queries.speech_gating(spark, str(tmp_path))
    assert found.agg({"n": "sum"}).first()[0] == words.count() == 2 * temporal_queries.speech_gating(spark, data).count()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") <= 4

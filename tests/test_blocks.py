import random

import pytest

from tessera.operators import blocks


@pytest.fixture
def small_blocks(spark):
    """Blocks of at most seven rows in several tasks, so that folds cross many."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sources(rng, n):
    """One source with most rows, some with few."""
    return [rng.choice([1, 1, 1, 1, 1, 2, 3, 4 + i % 9]) for i in range(n)]


def test_affine_scan(spark, small_blocks):
    rng = random.Random(1)
    rows = [(s, i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i, s in enumerate(sources(rng, 400))]
    decay = [0.9, 0.0]
    for settled in (False, True):
        want, state = {}, {}
        for s, i, b in rows:
            before = state.get(s) or ([b[k] / (1 - decay[k]) for k in (0, 1)] if settled else [0.0, 0.0])
            state[s] = [decay[k] * before[k] + b[k] for k in (0, 1)]
            want[i] = (s, state[s], before)
        df = spark.createDataFrame(rows, "src long, i long, b array<double>").repartition(3)
        got = blocks.affine_scan(df, by="src", order=["i"], keep=["i"], step="b", decay=decay, settled=settled).collect()
        assert len(got) == len(rows)
        for r in got:
            s, now, before = want[r.i]
            assert r.src == s and r.state == pytest.approx(now, abs=1e-12) and r.before == pytest.approx(before, abs=1e-12)


def test_moving_average_of_frames(spark, small_blocks):
    rng = random.Random(2)
    rows = [(s, i, [rng.random() for _ in range(6)]) for i, s in enumerate(sources(rng, 120))]
    acc, want = {}, {}
    for s, i, f in rows:
        acc[s] = [a * 0.75 + v * 0.25 for a, v in zip(acc[s], f)] if s in acc else f
        want[i] = acc[s]
    df = spark.createDataFrame(rows, "src long, i long, f array<float>")
    got = blocks.accumulate(df, by="src", order=["i"], key="i", value="f", weight=0.25).collect()
    assert len(got) == len(rows) and all(r.acc == pytest.approx(want[r.i], abs=1e-6) for r in got)


@pytest.mark.parametrize("gap", [0.5, 3.0, 40.0, 1e9])
def test_spacing(spark, small_blocks, gap):
    rng = random.Random(3)
    rows = [(s, rng.choice([rng.uniform(0, 100), rng.randrange(100) / 10]), i) for i, s in enumerate(sources(rng, 500))]
    want, last = set(), {}
    for s, t, i in sorted(rows):
        if s not in last or t - last[s] >= gap:
            last[s] = t
            want.add((s, t, i))
    df = spark.createDataFrame([*rows, (1, None, 9999)], "src long, t double, id long").repartition(4)
    got = [tuple(r) for r in blocks.spaced(df, by="src", t="t", key="id", gap=gap).collect()]
    assert sorted(got) == sorted(want)


def test_spacing_takes_the_exact_distance(spark):
    at = [0.1 * n for n in range(200)]  # sums of tenths miss whole numbers by a little
    rows = [(1, t, n) for n, t in enumerate(at)]
    want, last = [], None
    for _, t, n in rows:
        if last is None or t - last >= 0.3:
            last = t
            want.append(n)
    got = blocks.spaced(spark.createDataFrame(rows, "src long, t double, id long"), by="src", t="t", key="id", gap=0.3)
    assert sorted(r.id for r in got.collect()) == want


@pytest.mark.parametrize("seed, kinds", [(4, "eeeur"), (5, "euuur"), (6, "uurre"), (7, "euuuuuurrrrrr"), (8, "x")])
def test_undo_redo(spark, small_blocks, seed, kinds):
    rng = random.Random(seed)
    name = {"e": "edit", "u": "undo", "r": "redo", "x": None}
    rows, docs = [], sources(rng, 600)
    kind = "e"
    for i, s in enumerate(docs):
        kind = kind if rng.random() < 0.6 else rng.choice(kinds)  # in runs
        rows.append((s, i, name[kind] if rng.random() < 0.97 else "save", None if rng.random() < 0.1 else 1000 + i))
    want, stacks = {}, {}
    for s, i, k, v in rows:
        done, undone = stacks.setdefault(s, ([], []))
        if k == "edit":
            done.append(v)
            undone.clear()
        elif k == "undo" and done:
            undone.append(done.pop())
        elif k == "redo" and undone:
            done.append(undone.pop())
        want[i] = (s, i, done[-1] if done else None, len(done), len(undone))
    df = spark.createDataFrame(rows, "doc long, seq long, kind string, value long").repartition(4)
    assert sorted((tuple(r) for r in blocks.undo_redo(df).collect()), key=lambda r: r[1]) == [want[i] for i in range(len(rows))]


def test_empty_tables(spark):
    assert blocks.spaced(spark.createDataFrame([], "src long, t double, id long"), by="src", t="t", key="id", gap=1.0).collect() == []
    assert blocks.undo_redo(spark.createDataFrame([], "doc long, seq long, kind string, value long")).collect() == []
    assert blocks.pink_noise(spark.createDataFrame([], "src long, i long, value double")).collect() == []

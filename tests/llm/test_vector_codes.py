import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes
from tessera.llm.vector_codes import codebooks_hash, fitted_codes, nearest_entries, query

SCHEMA = "vec_id long, embedding array<double>, label string, code string, error int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    book = [[cut(v)[p] for _, v in kept[:entries]] for p in range(parts)]
    for n in range(rounds + 1):
        codes = [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book[p])) for p, x in enumerate(cut(v))] for _, v in kept]
        if n < rounds:
            for p in range(parts):
                for k in range(len(book[p])):
                    own = [cut(v)[p] for (_, v), c in zip(kept, codes) if c[p][1] == k]
                    if own:
                        book[p][k] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((str(i), "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c)) for (i, _), c in zip(kept, codes)), book


def frame(spark, rows):
    return spark.createDataFrame([(i, v, f"l{n % 3}" if n % 4 else None, "c", 1) for n, (i, v) in enumerate(rows)], SCHEMA)


def told(coded):
    return sorted((str(r.vec_id), bytes(r.codes).hex(), r.error) for r in coded.collect())


def vectors(seed, n, size, grid):
    """On a coarse grid many distances are equal."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-3, 4) / grid for _ in range(size)]) for i in range(n)]


@pytest.mark.parametrize("grid, size", [(256, 32), (256 / 3, 16), (0.37, 48)])
def test_against_brute_force(spark, grid, size):
    rows = vectors(size, 150, size, grid)
    rows += [(200, None), (201, [None] + [0.1] * (size - 1)), (202, [math.nan] * size), (203, [math.inf] + [0.0] * (size - 1)), (None, [0.5] * size), (3, rows[5][1]), (3, rows[5][1]), (3, rows[9][1])]
    rows += [(300 + n, rows[7][1]) for n in range(60)]
    coded, book = fitted_codes(frame(spark, rows).repartition(5), parts=8, entries=20)
    want, entries = brute(rows, 8, 20, 2)
    assert told(coded) == want
    assert book.tolist() == entries
    assert codebooks_hash(book) == hashlib.sha256(",".join(str(c) for p in entries for e in p for c in e).encode()).hexdigest()


def test_bounds_leave_distances_out_and_stay_true(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(-200, 200, (3000, 4)) + rng.integers(-3, 4, (8, 4))[rng.integers(0, 8, 3000)]
    entries = rng.integers(-200, 200, (64, 4))
    own, upper, lower = np.zeros(3000, np.int64), np.full(3000, 1 << 30), np.zeros((3000, 64), np.int64)
    for n in range(4):
        square, computed = nearest_entries(x, entries, own, upper, lower)
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(own, full.argmin(axis=1)) and np.array_equal(square, full.min(axis=1))
        assert (upper**2 >= square).all() and (lower**2 <= full).all()
        if n:
            assert computed.sum() < full.size / 3
        went = rng.integers(-2, 3, (64, 4)) if n < 2 else np.zeros((64, 4), np.int64)
        move = vector_codes._root_up((went**2).sum(axis=1))
        entries, upper, lower = entries + went, upper + move[own], np.maximum(lower - move, 0)
    assert (computed == 1).mean() > 0.2  # with entries at rest many parts meet only their own entry


def test_few_rows_other_lengths_and_empty_tables(spark):
    rows = [(4, [0.5] * 16), (2, [-0.5] * 16), (9, [0.25] * 16), (7, [1.0] * 15), (8, [])]
    coded, book = fitted_codes(frame(spark, rows))
    assert told(coded) == brute(rows[:3], 16, 64, 2)[0] and book.shape == (16, 3, 1)
    for none in ([], [(1, None)], [(1, [0.5] * 15)]):
        coded, book = fitted_codes(frame(spark, none))
        assert coded.collect() == [] and book is None
    assert codebooks_hash(None) == hashlib.sha256(b"").hexdigest()


def test_very_large_components_are_held(spark):
    rows = [(n, [(-1.0) ** n * 1e300, 1e30] + [n / 256] * 14) for n in range(10)]
    coded, book = fitted_codes(frame(spark, rows), entries=2)
    assert abs(book).max() == vector_codes.MOST
    assert len({r.codes[0] for r in coded.collect()}) == 2


def test_label_errors(spark, tmp_path):
    rows = vectors(3, 90, 16, 256 / 5)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = query(spark, str(tmp_path)).collect()
    label = dict(frame(spark, rows).select("vec_id", F.coalesce("label", F.lit("none"))).collect())
    sums = {}
    for r in got:
        sums[label[r.vec_id]] = sums.get(label[r.vec_id], 0) + r.error
    assert len(got) == 90 and len(sums) == 4
    assert all(r.label_error == sums[label[r.vec_id]] for r in got)
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == brute(rows, 16, 64, 2)[0]

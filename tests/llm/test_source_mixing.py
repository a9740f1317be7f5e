from collections import defaultdict

import pytest

from tessera.llm.source_mixing import mix_sources

SCHEMA = "doc_id long, text string, source string, size int, target string, draw int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA)


def filled(sizes, weights, epochs):
    """Water-filling by repeated clamping."""
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_words(spark):
    rows = [(i, "w " * (i % 40), "big") for i in range(300)] + [(1000 + i, "a\tb c" * (1 + i % 5), f"s{i % 5}") for i in range(100)]
    rows += [(2000, "x y z", None), (2001, None, "big"), (2002, "", "none"), (None, "p q", "s1"), (2003, "word " * 5000, "s2"), (2000, "x y z", None)]
    got = mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: n % 3 + 1 for n, s in enumerate(order)}
    for s, t in filled(sizes, weights, 3).items():
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(frame(spark, rows).repartition(3)).collect()), key=str)


def test_empty_table_and_empty_texts(spark):
    assert mix_sources(frame(spark, [])).collect() == []
    assert [r.taken for r in mix_sources(frame(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]

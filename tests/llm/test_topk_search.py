import math
import random

import numpy as np
import pytest

from tessera.llm import topk_search
from tessera.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, pivot int, score double"


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for m, (j, v) in enumerate(good) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 0.5) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, top_k(df).collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "LEAF", 4)
    monkeypatch.setattr(topk_search, "GROUP_BYTES", 8 * 6 * 20)
    rng = random.Random(7)
    quarter = lambda: rng.randrange(-64, 64) / 64
    rows = [(i, [quarter() for _ in range(6)]) for i in range(700)]
    same = rows[50][1]
    rows += [(1000 + i, same) for i in range(300)]  # a third of the rows are one vector
    rows += [(2000, None), (2050, [None] * 6), (2100, [float("nan")] + [0.5] * 5), (2150, [float("inf")] + [0.5] * 5), (None, same), (100, rows[100][1]), (2200, []), (2250, [0.25] * 3), (2300, [0.5] * 7), (2301, [2.0])]
    assert run(spark, rows) == brute(rows)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def clustered(seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, 8)) * 50
    return np.concatenate([c + rng.normal(size=(300, 8)) for c in centers]), centers[:2].repeat(3, axis=0) + rng.normal(size=(6, 8))


@pytest.mark.parametrize("repeat", [1, 5])
def test_net_separates_and_covers_on_every_level(repeat):
    x = np.random.default_rng(repeat).normal(size=(400, 3)).repeat(repeat, axis=0)
    net = topk_search.build_net(x, 150)
    points = x[net.order]
    between = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for level in sorted(set(net.level.tolist())):
        inside = np.flatnonzero(net.level >= level)
        apart = between[np.ix_(inside, inside)] + np.diag(np.full(len(inside), np.inf))
        assert apart.min() > 2.0**level
        to_level = np.sqrt(((x[:, None] - points[None, inside]) ** 2).sum(axis=2)).min(axis=1)
        below = net.distance[len(inside)] if len(inside) < len(points) else 0
        assert to_level.max() <= 2.0**level or below == 0
    for n in range(1, len(points)):
        assert net.level[net.parent[n]] > net.level[n] and between[n, net.parent[n]] <= 2.0 ** (net.level[n] + 1)


def test_nodes_hold_their_rows_within_their_radii(monkeypatch):
    monkeypatch.setattr(topk_search, "LEAF", 16)
    data, queries = clustered(4)
    root = topk_search.cover_tree(np.concatenate([data, queries]), len(data))
    assert sorted(root.data) == list(range(len(data))) and sorted(root.queries) == list(range(len(queries)))
    todo = [root]
    while todo:
        node = todo.pop()
        for rows, x, radius in ((node.data, data, node.data_radius), (node.queries, queries, node.query_radius)):
            assert not len(rows) or np.sqrt(((x[rows] - node.center) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.data for c in node.children])) == sorted(node.data)
            assert all(c.parent is node and c.level < node.level for c in node.children)
        todo += node.children


def searched(data, queries, raising=True):
    s = topk_search.DualSearch(queries, np.arange(len(queries)) - 10, data, np.arange(len(data)), np.arange(len(data)), 5, np.full(len(queries), -np.inf))
    if not raising:
        s._raise = lambda q: None
    s.run()
    assert np.allclose(s.scores, -np.sort(-(queries @ data.T), axis=1)[:, :5])
    return s.scored


def test_pairs_are_pruned_by_the_worst_score(monkeypatch):
    monkeypatch.setattr(topk_search, "LEAF", 16)
    data, queries = clustered(3)
    assert searched(data, queries, raising=False) == len(data) * len(queries)
    assert searched(data, queries) < len(data) * len(queries) / 4

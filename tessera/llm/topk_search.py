"""Exact top-k search for the largest inner products with dual cover trees.

Vectors are dealt to their nearest pivot; a query meets a pivot's vectors only if its inner product
with the pivot and the pivot's covering radius allow its k-th score. Inside a task queries and data
stand in one cover tree, which is walked against itself: a pair of nodes is left out if
its bound from both covering radii is under the worst k-th score of the first node's queries.
A first pass over each query's own pivot provides those scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, table

# The pivots are a sample of about the square root of all rows, of at most so many.
MOST_PIVOTS = 1024
# Data and queries that meet in one task, each.
GROUP_BYTES = 4 << 20
LEAF, TILE = 256, 1024
_SLACK = 1e-9


@dataclass
class Net:
    """Points in farthest-first order with the distance of each to those before it.

    Those with a distance over 2**i are level i of a cover tree: they lie apart by more than 2**i, and every
    point is within 2**i of one of them. ``parent`` is the nearest point of the level above a point's own;
    ``owner`` is, for every row, the nearest point of all.
    """

    order: np.ndarray
    distance: np.ndarray
    level: np.ndarray
    parent: np.ndarray
    owner: np.ndarray


def build_net(x: np.ndarray, most: int) -> Net:
    """The net of the rows of ``x`` down to ``most`` points, or to all different ones."""
    near = np.full(len(x), np.inf)
    owner = np.zeros(len(x), np.int64)
    order, distance = [], []
    at = 0
    while len(order) < most and (not order or near[at] > 0):
        order.append(at)
        distance.append(near[at])
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = d < near
        owner[closer], near[closer] = len(order) - 1, d[closer]
        at = int(near.argmax())
    distance[0] = 2 * distance[1] if len(distance) > 1 else 1.0  # the root is one level above all others
    level = np.ceil(np.log2(distance)).astype(int) - 1
    if len(level) > 1:
        level[0] = level[1] + 1
    parent = np.zeros(len(order), np.int64)
    points = x[order]
    for n in range(1, len(order)):
        above = int(np.searchsorted(-level[:n], -level[n], side="left"))  # levels descend
        parent[n] = ((points[:above] - points[n]) ** 2).sum(axis=1).argmin()
    return Net(np.array(order), np.array(distance), level, parent, owner)


@dataclass(eq=False)
class Node:
    """A point at a level with all rows below it; the radii are those of its queries and of its data."""

    center: np.ndarray
    level: int
    queries: np.ndarray
    data: np.ndarray
    query_radius: float = 0.0
    data_radius: float = 0.0
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None
    worst: float = -np.inf


def cover_tree(x: np.ndarray, n_data: int) -> Node:
    """One tree over the data (the first ``n_data`` rows of x) and the queries (the others)."""
    net = build_net(x, max(1, 2 * len(x) // LEAF))
    by_owner = np.argsort(net.owner, kind="stable")
    starts = np.searchsorted(net.owner[by_owner], np.arange(len(net.order) + 1))
    children: list[list[int]] = [[] for _ in net.order]
    for n in range(1, len(net.order)):
        children[net.parent[n]].append(n)

    def node(point: int, level: int, rows: np.ndarray, below: list[Node]) -> Node:
        out = Node(x[net.order[point]], level, rows[rows >= n_data] - n_data, rows[rows < n_data], children=below)
        far = np.sqrt(((x[rows] - out.center) ** 2).sum(axis=1))
        out.query_radius = float(far[rows >= n_data].max(initial=0.0))
        out.data_radius = float(far[rows < n_data].max(initial=0.0))
        for child in below:
            child.parent = out
        return out

    # points come after their parents, so the last ones are finished first
    done: list[tuple[Node, np.ndarray] | None] = [None] * len(net.order)
    for point in reversed(range(len(net.order))):
        rows = by_owner[starts[point] : starts[point + 1]]
        here = node(point, int(net.level[-1]) - 1, rows, [])
        for level in sorted({int(net.level[c]) for c in children[point]}):
            own = [done[c] for c in children[point] if net.level[c] == level]
            rows = np.concatenate([rows, *[r for _, r in own]])
            here = node(point, level + 1, rows, [here, *[c for c, _ in own]])
        done[point] = here, rows
        for c in children[point]:
            done[c] = None
    return done[0][0]


def bound(q: np.ndarray, q_radius: float, d: np.ndarray, d_radius: float) -> float:
    """No inner product of a point near q and one near d is larger."""
    lq, ld = float(np.sqrt(q @ q)), float(np.sqrt(d @ d))
    return (float(q @ d) + lq * d_radius + ld * q_radius + q_radius * d_radius) + _SLACK * (lq + q_radius) * (ld + d_radius)


class DualSearch:
    """The k best rows of ``data`` for every row of ``queries``; ties go to the smaller identifier.

    Rows of equal number are one row and no result for each other. ``floor`` has a score that each
    query's results must reach.
    """

    def __init__(self, queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, data_rows: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray):
        self.q, self.q_rows, self.d, self.d_rows, self.d_ids, self.k = queries, query_rows, data, data_rows, data_ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = floor
        self.scored = 0

    def run(self) -> None:
        root = cover_tree(np.concatenate([self.d, self.q]), len(self.d))
        self._start(root)
        order = 0
        heap = [(-bound(root.center, root.query_radius, root.center, root.data_radius), order, root, root)]
        while heap:  # the most promising pair first
            minus, _, q, d = heapq.heappop(heap)
            if -minus < q.worst:
                continue
            if not q.children and not d.children:
                self._base(q, d)
                continue
            split_q = q.children and (not d.children or q.query_radius > d.data_radius)
            for a, b in [(c, d) for c in q.children] if split_q else [(q, c) for c in d.children]:
                if len(a.queries) and len(b.data) and (most := bound(a.center, a.query_radius, b.center, b.data_radius)) >= a.worst:
                    order += 1
                    heapq.heappush(heap, (-most, order, a, b))

    def _start(self, q: Node) -> None:
        q.worst = float(self.floor[q.queries].min(initial=np.inf))
        for child in q.children:
            self._start(child)

    def _raise(self, q: Node) -> None:
        """After better scores in a leaf: its worst one, and those of the nodes above."""
        worst = float(np.maximum(self.scores[q.queries, -1], self.floor[q.queries]).min(initial=np.inf))
        at: Node | None = q
        while at is not None and worst > at.worst:
            at.worst = worst
            at = at.parent
            worst = min(c.worst for c in at.children) if at is not None else worst

    def _base(self, q: Node, d: Node) -> None:
        for a in range(0, len(q.queries), TILE):
            for b in range(0, len(d.data), TILE):
                self._score(q.queries[a : a + TILE], d.data[b : b + TILE])
        self._raise(q)

    def _score(self, queries: np.ndarray, data: np.ndarray) -> None:
        products = self.q[queries] @ self.d[data].T
        self.scored += products.size
        products[self.q_rows[queries][:, None] == self.d_rows[data][None, :]] = -np.inf
        k, wanted, most = self.k, np.maximum(self.scores[queries, -1], self.floor[queries]), products.max(axis=1)
        better = np.flatnonzero((most >= wanted) & (most > -np.inf))
        if not len(better):
            return
        some = products[better]
        if some.shape[1] > k:  # nothing under a row's own k-th product can count
            wanted[better] = np.maximum(wanted[better], np.partition(some, -k, axis=1)[:, -k])
        ids = self.d_ids[data]
        for n, at in enumerate(better.tolist()):
            row, hits = queries[at], np.flatnonzero(some[n] >= wanted[at])
            scores = np.concatenate([self.scores[row], some[n, hits]])
            names = np.concatenate([self.ids[row], ids[hits]])
            best = np.lexsort((names, -scores))[:k]
            self.scores[row], self.ids[row] = scores[best], names[best]


def _padded(lists: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of lists of numbers, filled up with zeros to ``width``."""
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * np.asarray(lists.flatten(), np.float64))
    return out


def _assigner(pivots: np.ndarray, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Quantise vectors and assign each to its nearest pivot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _padded(batch.column("vector"), scale, pivots.shape[1])
            square = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None, :], 0)
            near = square.argmin(axis=1)
            far = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(x))), batch.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(near.astype(np.int32)), pa.array(far)],
                names=["row", "vec_id", "body", "pivot", "distance"],
            )
            row += len(x)

    return assign


_ASKED = "pivot int, q_row long, q_id long, q_body binary, least double"


def _reach(pivots: np.ndarray, radii: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries with every pivot but their own that may have a vector of their k-th score; a radius under 0 has none."""
    lengths = np.sqrt((pivots**2).sum(axis=1))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.frombuffer(b"".join(batch.column("q_body").to_pylist()), np.float64).reshape(batch.num_rows, -1)
            long = np.sqrt((q**2).sum(axis=1))[:, None]
            most = q @ pivots.T + long * radii + _SLACK * long * (lengths + radii)
            may = (most >= np.asarray(batch.column("least"))[:, None]) & (radii >= 0)
            may[np.arange(len(q)), np.asarray(batch.column("pivot"))] = False
            query, pivot = np.nonzero(may)
            met = batch.take(pa.array(query))
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), *[met.column(c) for c in ("q_row", "q_id", "q_body", "least")]], names=["pivot", "q_row", "q_id", "q_body", "least"])

    return meet


def _searcher(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype({"row": int, "query_id": int, "vec_id": int, "score": float})
        q, d = (np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1) for x in (queries["q_body"], data["body"]))
        found = DualSearch(q, queries["q_row"].to_numpy(), d, data["row"].to_numpy(), data["vec_id"].to_numpy(), k, queries["least"].to_numpy(float))
        found.run()
        out = pd.DataFrame({"row": np.repeat(queries["q_row"].to_numpy(), k), "query_id": np.repeat(queries["q_id"].to_numpy(), k), "vec_id": found.ids.ravel(), "score": found.scores.ravel()})
        return out[np.isfinite(out["score"])]

    return search


_FOUND = "row long, query_id long, vec_id long, score double"


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best others.

    Components become floor(scale * x); scores are their inner products, exact below 2**53. All other rows
    are candidates, those that repeat the query's id too; equal scores go to the smaller id.
    A null id, a null or empty vector and one with a null or non-finite component take no part. Shorter
    vectors count as filled up with zeros. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(finite)
    good = good.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    count, width = good.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(min(MOST_PIVOTS, math.isqrt(count) + 1)).select("vector").collect()
    pivots = np.unique(_padded(pa.array([r["vector"] for r in sample], pa.list_(pa.float64())), scale, width), axis=0)
    placed = materialise(good.mapInArrow(_assigner(pivots, scale), "row long, vec_id long, body binary, pivot int, distance double"), "vectors")

    # One row for each pivot.
    tops = materialise(placed.groupBy("pivot").agg(F.count("*").alias("rows"), F.max("distance").alias("radius")), "pivots")
    radii = np.full(len(pivots), -1.0)
    for top in tops.collect():
        radii[top["pivot"]] = top["radius"]
    group_rows = max(LEAF, GROUP_BYTES // (8 * width))

    def searched(asked: DataFrame) -> DataFrame:
        """asked: queries with a pivot to search and the score that a result must reach."""
        groups = lambda n: F.ceil(F.col(n) / group_rows).cast("int")
        plan = tops.join(asked.groupBy("pivot").agg(F.count("*").alias("queries")), "pivot")
        plan = F.broadcast(materialise(plan.select("pivot", groups("rows").alias("salts"), groups("queries").alias("blocks")), "plan"))
        spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("long")).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        data = placed.join(plan, "pivot").select("pivot", spread("row", "salts").alias("salt"), each("blocks").alias("block"), "row", "vec_id", "body")
        met = asked.join(plan, "pivot").select(F.col("pivot").alias("q_pivot"), each("salts").alias("q_salt"), spread("q_row", "blocks").alias("q_block"), "q_row", "q_id", "q_body", "least")
        sides = data.groupBy("pivot", "salt", "block").cogroup(met.groupBy("q_pivot", "q_salt", "q_block"))
        return materialise(sides.applyInPandas(_searcher(k), _FOUND), "found")

    queries = placed.where(F.col("vec_id") % every == 0).select("pivot", F.col("row").alias("q_row"), F.col("vec_id").alias("q_id"), F.col("body").alias("q_body"))
    first = searched(queries.withColumn("least", F.lit(float("-inf"))))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select(F.col("row").alias("q_row"), F.col("score").alias("kth"))
    asked = queries.join(kth, "q_row", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf"))))
    rest = searched(materialise(asked.mapInArrow(_reach(pivots, radii), _ASKED), "asked"))
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Links between sets of hashed shingles by adaptive multi-match prefixes.

All sets keep their members in one order, rarest first. Two sets of sizes x and y that are linked share at least
``least_overlap(x, y)`` members, so whatever m is, the first x - overlap + m members of one and the first y - overlap + m of the other
share at least m. Each set chooses how far to lengthen its prefix by an estimate of what its
members' frequencies cost; a pair is a candidate if the prefixes share as many members as the shorter lengthening asks for.

Before sets meet pair by pair each is compared with a few hubs. What two sets have in common is at most what either shares with a hub, and what
either shares with any set besides; that leaves out most pairs of families whose members are all a little too far from each other.

Sizes fall in classes and a prefix is as long as partners of a class require, so sets meet under a key of member and pair of classes.
Sets that no other can share a rare member with don't meet at all, however many common members they have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialise

# Sizes of one class differ by so much at most.
SIZE_STEP = 1.04
# Matches that a set may ask for.
MATCHES = (1, 2, 4, 8, 16)
# Comparing two sets costs as much as reading so many rows for each of their members.
COMPARE = 1 / 16
# A set is compared with so many of the sets that stand for its keys before the rest meets pair by pair.
HUBS = 4


def least_overlap(n: Column | int, m: Column | int, percent: int) -> Column | int:
    """How many members linked sets of these sizes share at least."""
    whole = percent * (n + m)
    return F.ceil(whole / (100 + percent)) if isinstance(whole, Column) else -(-whole // (100 + percent))


def least_partner(n: Column, percent: int) -> Column:
    return F.ceil(percent * n / 100)


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, one in zip(batch.column("node"), batch.column("shingles")):
            token = np.frombuffer(one.as_buffer(), np.int64)
            for at in range(0, len(token), 1 << 18):
                part = token[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node.as_py())), pa.array(np.full(len(part), len(token))), pa.array(part)], names=["node", "n", "token"])


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (key, of, with, node, place, n, matches, n_common) for the keys under which each set meets others; a key has sets of both its
    classes, of one and with the other, or at least two of its only one.

    ``sets`` has (node, shingles), sorted hashes as bytes, each set once. ``place`` is the member's place from 1 in its set, ``matches`` how many shared
    members the set asks for and ``n_common`` how many of its members other sets have too.
    """
    members = materialise(sets.mapInArrow(_members, "node long, n long, token long"), "members")
    often = materialise(members.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "often")
    own = Window.partitionBy("node")
    found = members.join(often, "token").withColumn("n_common", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("often", "token")) + F.col("n") - F.col("n_common"))
    # members that no other set has come first, and take up place but no rows
    longest = F.col("n") - least_overlap(F.col("n"), least_partner(F.col("n"), percent), percent)
    placed = materialise(found.where(F.col("place") <= longest + max(MATCHES)).select("node", "n", "token", "often", "place", "n_common"), "placed")
    # the estimate is for partners of the set's own size
    usual = F.col("n") - least_overlap(F.col("n"), F.col("n"), percent)
    rows = [F.sum(F.when(F.col("place") <= usual + m, F.col("often")).otherwise(0)).alias(f"rows_{m}") for m in MATCHES]
    costs = placed.groupBy("node").agg(F.first("n").alias("n"), *rows)
    cost = [F.struct((F.col(f"rows_{m}") * (1 + F.col("n") * COMPARE / m)).alias("cost"), F.lit(m).alias("matches")) for m in MATCHES]
    chosen = materialise(costs.select("node", F.array_min(F.array(*cost))["matches"].alias("matches")), "chosen")
    smallest = least_partner(F.col("n"), percent)
    classes = F.sequence(size_class(smallest), size_class(F.greatest(smallest, F.floor(100 * F.col("n") / percent))))

    def met(k: Column) -> Column:
        """Whether a partner of class k could need this member."""
        size = F.greatest(F.floor(F.pow(F.lit(SIZE_STEP), k) * (1 - 1e-9)), smallest)
        return F.col("place") <= F.col("n") - least_overlap(F.col("n"), size, percent) + F.col("matches")

    with_classes = placed.join(chosen, "node").withColumn("of", size_class(F.col("n"))).withColumn("with", F.explode(F.filter(classes, met)))
    key = F.xxhash64("token", F.least("of", "with"), F.greatest("of", "with")).alias("key")
    keyed = materialise(with_classes.select(key, "of", "with", "node", "place", "n", "matches", "n_common"), "keyed")
    sides = keyed.groupBy("key").agg(F.count("*").alias("n_sets"), F.min("of").alias("low"), F.max("of").alias("high"), F.max("with").alias("other"))
    several = materialise(sides.where("low < high OR (high = other AND n_sets > 1)").select("key"), "several")
    out = materialise(keyed.join(several, "key"), "prefix_keys")
    discard(members, often, placed, chosen, keyed, several)
    return out


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``both``, how many members their sets share, and their sizes n_a and n_b."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                counts.append((int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()), len(x), len(y)))
            arrays = [pa.array(c, pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *arrays], names=["a", "b", "both", "n_a", "n_b"])

    # a set with many partners is a, so it comes last and is moved once
    full = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    full = full.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(count, "a long, b long, both long, n_a long, n_b long")


def linked(compared: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among compared pairs."""
    return compared.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def with_hubs(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """The overlaps of sets (b) with the hubs (a) that they share most keys with; a key's hub is its set with the largest share of common members."""
    share = F.col("n_common") / F.col("n")
    hubs = materialise(keys.groupBy("key").agg(F.max_by("node", F.struct(share, "node")).alias("a")), "hubs")
    near = keys.join(hubs, "key").where("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.col("shared").desc(), "a"))
    pairs = materialise(near.withColumn("nth", nth).where(F.col("nth") <= HUBS).select("a", "b"), "hub_pairs")
    out = materialise(overlaps(pairs, sets), "with_hubs")
    discard(hubs, pairs)
    return out


def _hub_maps(keys: DataFrame, compared: DataFrame) -> DataFrame:
    """For each node a map from its hubs to how many members they share, and how many of its common members the hub does not have."""
    common = keys.groupBy("node").agg(F.first("n").alias("n"), F.first("n_common").alias("n_common"))
    seen = compared.select(F.col("b").alias("node"), F.col("a").alias("hub"), "both").unionByName(compared.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.col("n_a").alias("both")).distinct())
    entry = F.struct("hub", F.struct("both", (F.col("n_common") - F.col("both")).alias("besides")))
    # a hub has all of its own members
    return seen.join(common, "node").groupBy("node").agg(F.map_from_entries(F.collect_list(entry)).alias("hubs"))


def links_across(keys: DataFrame, compared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of different labels (node, label); ``compared`` has their overlaps with hubs.

    Under a key of several labels the sets outside its most frequent label meet all others. Only pairs whose prefixes, as long as their
    two sizes require, share enough members, and whose hubs allow a link, are compared.
    """
    labelled = materialise(keys.join(labels, "node").select("key", "of", "with", "node", "place", "n", "matches", "label"), "labelled_keys")
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n_sets"))
    largest = sizes.groupBy("key").agg(F.max_by("label", F.struct("n_sets", "label")).alias("largest"), F.count("*").alias("apart")).where("apart > 1").drop("apart")
    apart = materialise(largest, "mixed_keys")
    maps = materialise(_hub_maps(keys, compared), "hub_maps")
    mixed = materialise(labelled.join(apart, "key").join(maps, "node", "left"), "mixed")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("node", "place", "n", "matches", "label", "hubs")]
    outside = mixed.where("label <> largest").select("key", F.col("with").alias("class"), *side("a"))
    inside = mixed.select("key", F.col("of").alias("class"), (F.col("label") == F.col("largest")).alias("of_largest"), *side("b"))
    overlap = least_overlap(F.col("n_a"), F.col("n_b"), percent)
    matches = F.least("matches_a", "matches_b", overlap)
    # of what two sets share, so much is in the hub and so much besides, at most
    most = lambda x, y: F.least(x["both"], y["both"]) + F.least(x["besides"], y["besides"])
    may = lambda x, y: F.coalesce(most(x, y) >= overlap, F.lit(True))
    spare = matches - overlap
    met = (
        (F.col("label_a") != F.col("label_b"))
        & (F.col("of_largest") | (F.col("node_a") < F.col("node_b")))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (F.col("place_a") <= F.col("n_a") + spare)
        & (F.col("place_b") <= F.col("n_b") + spare)
        & F.coalesce(F.forall(F.map_entries("hubs_a"), lambda hub: may(hub["value"], F.element_at("hubs_b", hub["key"]))), F.lit(True))
    )
    # a pair can lie either way round under two keys
    pair = F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")
    pairs = outside.join(inside, ["key", "class"]).where(met).groupBy(*pair).agg(F.count("*").alias("shared"), F.first(matches).alias("matches"))
    candidates = materialise(pairs.where("shared >= matches").select("a", "b"), "candidates")
    out = materialise(linked(overlaps(candidates, sets), percent), "links_across")
    discard(labelled, apart, maps, mixed, candidates)
    return out

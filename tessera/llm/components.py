"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialise, same_table


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node in ``links`` (columns a, b); label is the component's smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so chains shorten by more than half. Every round is a written table: an executor lost
    in one round doesn't undo the rounds before.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        nearer = materialise(nearer, "nearer")
        up = nearer.select(F.col("node").alias("next"), F.col("next").alias("up"))
        jumped = materialise(nearer.join(up, "next").select("node", F.col("label").alias("old"), F.least("next", "up").alias("label")), "labels")
        discard(labels, nearer)
        labels = same_table(jumped.select("node", "label"), jumped)
        if jumped.where("old <> label").isEmpty():
            discard(both)
            return labels


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after more links (a, b) between those nodes."""
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias("label_" + c)) for c in "ab")
    between = links.join(a, "a").join(b, "b").where("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    found = components(between)
    merged = found.select(F.col("node").alias("label"), F.col("label").alias("merged"))
    out = materialise(labels.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label")), "labels")
    discard(found)
    return out

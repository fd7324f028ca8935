"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node of its component.

    Each round takes the least label among neighbours, then jumps from labels to their own
    labels, so a chain shortens by more than half; rounds end when nothing changes. Minima
    combine before the shuffle, so a hub is no single task's work. Lineage is cut by
    reliable checkpoints. No edges give no nodes.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = cut_lineage(step.join(jump, step.root == jump._n, "left").select("node", F.coalesce(F.least("root", "_r"), "root").alias("root"), "was"))
        labels = new.select("node", "root")
        if new.filter("root != was").isEmpty():
            return labels

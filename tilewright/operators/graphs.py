"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import cut_lineage


def least_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the least node that it is connected to.

    A round takes the least root among the neighbours and then the root's own root, so the
    way to the root shrinks by half or more and rounds are logarithmic in the longest way.
    Minima combine in the task before they are shuffled, so a node with many neighbours is
    no single task's work.
    """
    ends = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    roots = cut_lineage(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    changed = True
    while changed:
        near = ends.join(roots, ends.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        # a root learns of the least root that any of its nodes has met
        met = roots.join(near, roots.node == near.a).select("node", "root", F.least("root", "near").alias("low"))
        hooked = met.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("next"))
        step = met.join(hooked, met.root == hooked.r).select("node", "root", F.least("low", "next").alias("new"))
        jump = step.select(F.col("node").alias("n"), F.col("new").alias("of_new"))
        moved = cut_lineage(step.join(jump, step.new == jump.n).select("node", F.least("new", "of_new").alias("new"), "root"))
        changed = not moved.filter("new < root").isEmpty()
        roots = moved.select("node", F.col("new").alias("root"))
    return roots

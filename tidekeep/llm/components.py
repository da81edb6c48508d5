"""Connected components of an edge table, by hooking to smaller neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every row of ``nodes`` (column ``node``) under ``edges`` (a, b).

    The component is the smallest node reachable. Each round rewrites the edges by the labels so
    far, hooks every label to its smallest neighbour, follows two pointers and drops the edges
    that became loops, so their number shrinks; rounds end when none is left. Rounds are written
    to the shared folder. Neighbours are aggregated, never listed, so a node may have any number.
    """
    labels = nodes.select("node", F.col("node").alias("component"))
    left = written(edges.filter("a != b").select("a", "b").distinct(), "edges")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(
            F.col("a").alias("x"), F.least("a", "p").alias("p"))
        parent = written(parent, "parents")
        above = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
        jumped = written(parent.join(above, "p").select(
            F.col("x").alias("component"), F.col("q").alias("root")), "roots")
        labels = written(labels.join(jumped, "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")), "labels")
        ends = [jumped.select(F.col("component").alias(c), F.col("root").alias("r" + c))
                for c in ("a", "b")]
        left = written(left.join(ends[0], "a").join(ends[1], "b").filter("ra != rb").select(
            F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    # A label may point to a node that was hooked in the same round; follow until it is its own.
    return _settled(labels)


def _settled(labels: DataFrame) -> DataFrame:
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = written(labels.join(up, "component", "left").select(
            "node", F.coalesce("root", "component").alias("component"),
            (F.coalesce("root", "component") != F.col("component")).alias("moved")), "settled")
        if labels.filter("moved").isEmpty():
            return labels.drop("moved")

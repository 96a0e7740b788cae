"""Connected components of an edge table, by stars that shrink to one level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop, staged


def _outward(edges: DataFrame) -> DataFrame:
    """Every node hands the least of its neighbours and itself to the greater ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _inward(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours go to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the root is the least node that it
    is connected with. Loops only name a node; null ends are left out. Neighbours are
    joined, never gathered, so a hub is no hot cell; each round is written and the one
    before removed. An empty table gives no rows."""
    known = edges.where("a is not null and b is not null").select("a", "b")
    nodes = known.select(F.col("a").alias("node")).unionByName(known.select(F.col("b").alias("node"))).distinct()
    now = staged(known.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # done when no parent has a parent and no node has two
        parents = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if parents.where("n > 1").isEmpty() and now.select(F.col("b").alias("a")).distinct().join(parents, "a", "left_semi").isEmpty():
            return nodes.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))
        last, now = now, staged(_inward(_outward(now)), "edges")
        drop(last)

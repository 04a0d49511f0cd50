"""Connected components of a graph given as edges, by alternating star steps on Spark tables.

Every round replaces the edges by edges to the least neighbour: first for the
neighbours above a node, then for those below it. The number of rounds grows
with the logarithm of the longest path. Each round is written to the shared
folder, so it survives lost executors, and only a count comes to the driver.
The least neighbour of a node is found by an aggregation that combines before
the shuffle; a node with very many neighbours is a hot key of the join that
follows, whose pairs of numbers meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, above: bool) -> DataFrame:
    """Edges (a > b) after a large star (``above``) or a small star."""
    if above:
        to = _both_ways(edges)
        least = to.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = to.where("b > a").join(least, "a")
    else:
        to = edges.select("a", "b")
        least = to.groupBy("a").agg(F.min("b").alias("m"))
        met = to.join(least, "a")
        # The node itself follows its least neighbour too.
        return met.select(F.col("b").alias("a"), "m").union(least.select("a", "m")).where("a != m").select(
            "a", F.col("m").alias("b")
        ).distinct()
    return met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of an edge (columns ``a``, ``b``); the component is its least node."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    seen = None
    while True:
        edges = cut_lineage(_star(_star(edges, above=True), above=False))
        # When all edges are stars, no step changes them: count and sums stay.
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("b")
        ).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

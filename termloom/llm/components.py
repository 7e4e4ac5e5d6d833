"""Connected components of a graph that lies in a table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # min() combines before the shuffle, so a node with very many neighbours costs a row per task;
    # in the join back, adaptive execution splits the rows of such a node.
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the smallest of them."""
    down = edges.where("b < a")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    others = down.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.union(least.select("a", F.col("least").alias("b"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most and nothing hangs on a node that hangs."""
    one, zero = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("node"), one.alias("hangs"), zero.alias("holds")).unionAll(
        edges.select(F.col("b").alias("node"), zero.alias("hangs"), one.alias("holds"))
    )
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest reachable node.

    Edges may repeat, point either way or join a node to itself; rows with a null are ignored. Every
    round is written to the shared folder. The number of rounds is about the logarithm of the
    longest path; they end when all components are stars. No edges give no rows.
    """
    known = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = materialize(
        known.where("a is not null and b is not null and a != b").distinct(), "edges"
    )
    while not _is_star_forest(current):
        current = materialize(_small_star(_large_star(current)), "stars")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )

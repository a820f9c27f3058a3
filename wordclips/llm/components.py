"""Connected components of a graph given by its edges, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, under
the smallest node it knows; after a number of rounds that grows with the
logarithm of the graph every component is a star.  Only per-node minima and
equi-joins are used, so a node with very many edges is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordclips.session import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    two = _both(edges)
    low = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return two.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(low, "a")
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        low.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one node, and no node both hangs and holds."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("v").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where("hangs + holds > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any orderable ids -> (node, root), root the smallest of its component.

    Loops, repeated edges and either direction are fine; nodes without an edge
    to another node are not in the result.  Null ends are ignored.
    """
    now = stored(edges.select("a", "b").where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        now = stored(_small(_large(now)), "edges")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())

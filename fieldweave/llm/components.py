"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = shared.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    # both sides of the join are read from tables, so that Spark can split a node with many neighbours
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them (edges go from large to small)."""
    least = shared.materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    far = edges.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return far.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Does every edge lead to the centre of a star: has no node two smaller neighbours, or one and a larger one?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    met = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return met.where("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v longs) that isn't the least of its component.

    Each step is a written table in the shared folder; nothing is gathered.  The end is seen by
    one count of each node's neighbours: edges go from larger to smaller nodes, so stars have their least node as
    centre.  Steps grow with the logarithm of the longest path; edges that are stars already take
    none.  Loops and repeated edges are ignored; no edges give no rows.
    """
    now = shared.materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(now):
        old = now
        now = shared.materialize(_small_star(shared.materialize(_large_star(now))))
        shared.discard(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Connected components by alternating large-star and small-star, on DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playlake.llm.scratch import Scope, materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself: then nothing can change any more."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and several.isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges with u > v.

    Both sides of the join are written tables, so that a node with very many neighbours is split between tasks.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        found = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        found = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return materialize(found.filter("u <> v").distinct(), "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs, in either direction, repeated or not → (node, label): the least node reachable.

    Nodes without a smaller one reachable aren't in the result; edges with a null end link nothing.  No edges give no rows.
    """
    with Scope(edges.sparkSession) as scope:
        edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
        while not _stars(edges):
            edges = _star(_star(edges, large=True), large=False)
        scope.keep(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))

"""Connected components of a large edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _least(edges: DataFrame) -> DataFrame:
    """Smallest node among every node and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    more = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return more.unionByName(inner).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges(u, v)`` with the smallest node it is
    connected to.  Large-star and small-star steps alternate until all edges
    lead straight to a root.  Each step is a minimum per node (combined
    map-side) that is joined back to the edges; the joins are plain inner joins
    to one row per node, which adaptive execution splits where a node has very
    many edges, so no large node and no component is ever gathered."""
    now = stage(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_star(now):
        # large star: every larger neighbour of u moves to u's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u != v").distinct(), "large")
        # small star: u and its smaller neighbours move to the smallest of them
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round over directed edges (u, v): neighbours of u are tied to the least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        return stored(tied.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "star")
    out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return stored(out.where("u <> v").distinct(), "star")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent, and no parent has one itself."""
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    nodes = nodes.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    worst = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return worst.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long); the component is its smallest node.

    Each round writes its edges to the shared folder; rounds grow with the logarithm of the
    diameter. Loops and repeated edges change nothing; no edges give no rows.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(now):
        large = _star(now, True)
        small = _star(large, False)
        discard(now, large)
        now = small
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

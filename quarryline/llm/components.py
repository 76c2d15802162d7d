"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table with columns a and b.

    A component is named by its smallest node. Every round is two joins with per-node minima
    (combined before the shuffle, so a hub with a third of all edges costs one row per edge)
    and ends in a written table; rounds grow with the logarithm of the diameter.
    """
    ordered = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    current = written(ordered, "links")
    mark = _mark(current)
    while True:
        current = written(_small_star(_large_star(current)), "links")
        previous, mark = mark, _mark(current)
        if mark == previous:
            return _labels(current)


def _mark(edges: DataFrame):
    """Size and content mark of an edge set."""
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))
    ).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _labels(stars: DataFrame) -> DataFrame:
    """At the end every edge joins a node to the smallest node of its component."""
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(centres)

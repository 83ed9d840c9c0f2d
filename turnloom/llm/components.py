"""Connected components by alternating large-star and small-star steps on tables of edges.

Every step is a map-side pre-aggregated minimum, written as a table, and a join with it that adaptive
execution may split, so a node with very many edges is not gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")))
    return both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them; edges run from small to large."""
    least = scratch(edges.groupBy("b").agg(F.min("a").alias("least")))
    moved = edges.join(least, "b").where("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(least.select(F.col("least").alias("a"), "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.crc32(F.concat_ws(" ", "a", "b"))).alias("s")).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node that it reaches."""
    edges = scratch(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    state = None
    while state != (state := _state(edges)):
        edges = scratch(_small_star(_large_star(edges)))
    own = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(own)

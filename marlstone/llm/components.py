"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation (with partial sums before the shuffle) and one join; edges
shrink towards stars around the least node of each component. Nothing is gathered on the driver but a count
and a checksum per round, and every round's edges are written to the shared folder, so lineage stays short.

Defined results: repeated edges, edges in both directions and loops change nothing; edges with a null are left out; a node without any edge has no row; no edges give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(pairs: DataFrame) -> DataFrame:
    """For directed pairs (x, y): (x, m) with m the least of x and all its y."""
    return pairs.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    joined = both.join(_least(both), "x").where(F.col("y") > F.col("x"))
    return joined.select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = _least(down)
    to_least = down.join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return to_least.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (u, v) edges; the root is the least node of its component. Nulls are no nodes."""
    spark = edges.sparkSession
    both = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, path = common.written(both.distinct())
    mark = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (got["n"], got["s"]) == mark or not got["n"]:
            break
        mark = (got["n"], got["s"])
        after, new = common.written(_small_star(_large_star(now)))
        common.drop(spark, path)
        now, path = after, new
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of the undirected edges ``u, v``; the component is its least node.

    Loops and repeated edges are dropped; edges with a null end are ignored. Each
    round is written to the shared folder; a round moves every edge of a node to
    the least node it knows, so the rounds grow as the logarithm of the longest
    path. Minima are combined before the shuffle and written, so that few are
    broadcast as Spark sees fit, and joins on a node with very many edges can be
    split where they are many.
    """
    u, v = F.col("u"), F.col("v")
    now = materialize(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        now = materialize(_small_star(_large_star(now)))
        after = mark(now)
        if after == before:
            break
        before = after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

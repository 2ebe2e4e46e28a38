"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from earmark.llm.store import forget, settle


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    per = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return per.where("child + parent > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    return (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u > v"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = edges.repartition("u").distinct()          # dealt once, for the minima and for the join with them
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low.hint("shuffle_hash"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link; a component is named by its smallest node.

    Links may repeat, in either direction, and join a node to itself; links with a NULL end count for nothing. Every
    round is a written table. The small star deals links by node once: those of one node pass through one task, as a stream.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    edges = links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(
        x.isNotNull() & y.isNotNull()).where("u > v").distinct()
    edges = settle(edges)
    while not _stars(edges):
        before, edges = edges, settle(_small_star(_large_star(edges)))
        forget(before)
    # every component is now a star around its smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table, by alternating stars.

Each round points every node at the smallest neighbour it knows (large star,
then small star) until no edge changes; a path halves in length each round.
A hot node (the centre of a large star) is pre-aggregated by ``min`` and joined back; the
minima are stored, so that both sides of the join are plain shuffles, whose hot
partitions adaptive execution splits. Nothing but two numbers a round comes to the driver.

What a round makes is written as a table under the shared checkpoint folder and read
again. A checkpoint would keep the size that the planner expected, and every join
multiplies expected sizes: after some rounds they are numbers of megabytes each in the
driver. A table has the size of its files. The folder goes when the result is checkpointed, and
so do the rounds' broadcasts and shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import cut_lineage, drop_folder, free_unused, scratch_folder

_Store = Callable[[DataFrame], DataFrame]


def _large_star(edges: DataFrame, store: _Store) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, store: _Store) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = store(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of ``edges`` (columns ``a, b``, long); a component is its smallest node."""
    spark = edges.sparkSession
    folder, stored = scratch_folder(spark, "components"), 0

    def store(rows: DataFrame) -> DataFrame:
        nonlocal stored
        stored += 1
        rows.write.parquet(f"{folder}/{stored}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{stored}")

    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        large = store(_large_star(edges, store).distinct())
        edges = store(_small_star(large, store).distinct())
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = cut_lineage(stars.union(stars.select("component", "component").distinct()))
    drop_folder(spark, folder)
    free_unused(spark)
    return out

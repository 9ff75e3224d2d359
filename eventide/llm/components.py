"""Connected components by alternating large-star and small-star steps, each a Spark job.

Every step's edges are written to the shared folder, so a lost executor costs one step at most; the edges of
the step before are deleted then. As long as the written edges are few (``common.BROADCAST_ROWS``), the smallest
neighbours of all nodes, of which there are at most two per edge, are sent to every executor, and a node with many
edges is not dealt to one task; beyond, the join is a shuffle, which Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import common


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(F.broadcast(least) if few else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(F.broadcast(least) if few else least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Gives id, component (the smallest id it holds) for every id that has an edge to another."""
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[str, DataFrame]:
        path = common.new_path(spark, "edges")
        df.write.option("compression", "zstd").parquet(path)
        return path, spark.read.schema("u long, v long").parquet(path)

    path, now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    few, seen = common.small(now), None  # no step adds edges
    while True:
        before, (path, now) = path, written(_small_star(_large_star(now, few), few).where("u != v").distinct())
        files.remove(spark, before)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # now every edge leads from a node to the root of its star
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

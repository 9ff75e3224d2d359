"""The event timeline, long and wide, and the derived shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time_bucket import time_bucket

TYPES = ("Warning", "Normal")


def timeline(events: DataFrame, width: str, where: Column | None = None, time: str = "lastTimestamp") -> DataFrame:
    """bucket, type, count: the number of events by time bucket and type."""
    rows = events if where is None else events.where(where)
    return rows.groupBy(time_bucket(time, width).alias("bucket"), "type").agg(F.count("*").alias("count"))


def timeline_wide(events: DataFrame, width: str, time: str = "lastTimestamp") -> DataFrame:
    """A row per bucket that has events: total, and a column per plotted type. Other types count in the total only."""
    long = timeline(events, width, time=time)
    sums = [F.coalesce(F.sum(F.when(F.col("type") == t, F.col("count"))), F.lit(0)).alias(t) for t in TYPES]
    return long.groupBy("bucket").agg(F.sum("count").alias("total"), *sums)


def timeline_shares(events: DataFrame, width: str, time: str = "lastTimestamp") -> DataFrame:
    """The wide timeline with each type's percentage of the plotted events."""
    wide = timeline_wide(events, width, time)
    plotted = F.col("Warning") + F.col("Normal")
    return wide.select("bucket", "total", *[F.when(plotted == 0, F.lit(0.0)).otherwise(F.col(t) * 100.0 / plotted).alias(f"{t.lower()}_pct") for t in TYPES])


def share_of_largest(counts: DataFrame, column: str = "count") -> DataFrame:
    """Adds each count's ratio to the largest one, and the severity that follows from it. The largest is one row, which is broadcast."""
    largest = counts.agg(F.max(column).alias("_largest"))
    rows = counts.crossJoin(F.broadcast(largest)).withColumn("ratio", F.col(column) / F.col("_largest")).drop("_largest")
    return rows.withColumn("severity", F.when(F.col("ratio") > 0.8, "error").when(F.col("ratio") > 0.5, "warning").otherwise("info"))


def reason_severity(reason: str = "reason") -> Column:
    has = lambda *parts: F.lit(False) if not parts else F.col(reason).contains(parts[0]) | has(*parts[1:])
    return F.when(has("Failed", "Error"), "error").when(has("Unhealthy", "Warning", "OutOf"), "warning").otherwise("info")

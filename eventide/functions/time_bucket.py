"""Time buckets of fixed width, from a Monday on, in UTC."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: 2000-01-03, a Monday, in seconds; months and years count from 2000-01-01.
ORIGIN = 946_857_600
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
# The widths that a chart may have, in seconds.
LADDER = {"10 seconds": 10, "15 seconds": 15, "30 seconds": 30, "1 minutes": 60, "5 minutes": 300, "15 minutes": 900, "30 minutes": 1800, "1 hours": 3600, "3 hours": 10_800, "6 hours": 21_600, "12 hours": 43_200, "1 day": 86_400}


def width_seconds(width: str) -> int:
    found = re.fullmatch(r"(\d+)\s*(second|minute|hour|day|week)s?", width.strip().lower())
    if not found or int(found[1]) < 1:
        raise ValueError(f"not a bucket width: {width!r}")
    return int(found[1]) * UNITS[found[2]]


def time_bucket(time: str | Column, width: str) -> Column:
    """The start of the time's bucket. It keeps the column's type, with or without time zone."""
    seconds = width_seconds(width)
    shift = ORIGIN % seconds
    return F.window(time, f"{seconds} seconds", f"{seconds} seconds", f"{shift} seconds")["start"]


def register_time_bucket(spark: SparkSession) -> None:
    """SQL functions time_bucket(INTERVAL, TIMESTAMP) and month_bucket(months, TIMESTAMP), which Spark inlines."""
    width = "((CAST(extract(DAY FROM w) AS BIGINT) * 86400 + extract(HOUR FROM w) * 3600 + extract(MINUTE FROM w) * 60) * 1000000 + CAST(extract(SECOND FROM w) * 1000000 AS BIGINT))"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION time_bucket(w INTERVAL DAY TO SECOND, ts TIMESTAMP) RETURNS TIMESTAMP "
        f"RETURN timestamp_micros(unix_micros(ts) - pmod(unix_micros(ts) - {ORIGIN * 1_000_000}, {width}))"
    )
    months = "((year(ts) - 2000) * 12 + month(ts) - 1)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION month_bucket(n INT, ts TIMESTAMP) RETURNS TIMESTAMP "
        f"RETURN CAST(add_months(DATE '2000-01-01', {months} - pmod({months}, n)) AS TIMESTAMP)"
    )


def dynamic_width(start: datetime, end: datetime, points: int = 20) -> str:
    """The width for a chart of a range: the last one below a points-th of it.

    Ranges of up to 200 seconds give the smallest width.
    """
    seconds = int((end - start).total_seconds())
    target = seconds / points
    smaller = [label for label, width in LADDER.items() if width < target]
    if not smaller:
        return "10 seconds"
    return "1 day" if target > 86_400 else smaller[-1]

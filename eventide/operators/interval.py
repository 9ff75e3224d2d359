"""Interval join: each left row with the right rows whose time lies within an interval around its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def binned(left: DataFrame, right: DataFrame, keys: list[str], time: str, low: int, high: int, width: int | None = None) -> DataFrame:
    """The pairs that meet in a bin: ``l`` and ``r``, the rows, and ``after``, the microseconds from the left row's time to the right row's.

    Time is cut into bins, as wide as the interval unless said otherwise (in seconds). A right row lies in one bin, a left row is copied to those that its
    interval touches, two if they are as wide. Rows only meet within a key and bin, so a frequent key is dealt to as many tasks as it has
    bins, and of its rows only those of neighbouring bins are compared. No pair meets twice.
    """
    step = (width or max(1, high - low)) * 1_000_000
    bin_of = lambda micros: F.floor(micros / F.lit(step)).cast("long")
    at = _micros(F.col(time))
    touched = F.explode(F.sequence(bin_of(at + low * 1_000_000), bin_of(at + high * 1_000_000)))
    named = [F.col(k).alias(f"key{n}") for n, k in enumerate(keys)]
    mine = left.where(F.col(time).isNotNull()).select(*named, touched.alias("bin"), at.alias("left_at"), F.struct(*left.columns).alias("l"))
    others = right.where(F.col(time).isNotNull()).select(*named, bin_of(at).alias("bin"), at.alias("right_at"), F.struct(*right.columns).alias("r"))
    met = mine.join(others, [f"key{n}" for n in range(len(keys))] + ["bin"])
    return met.select("l", "r", (F.col("right_at") - F.col("left_at")).alias("after"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, low: int, high: int, closed: str = "both", width: int | None = None) -> DataFrame:
    """An inner join on the keys and on right.time - left.time between low and high seconds, as columns ``l`` and ``r``.

    closed: which ends of the interval count: both, left, right or neither. Null keys and times match nothing; rows that repeat each
    match.
    """
    if high < low:
        raise ValueError("the interval ends before it begins")
    pairs, after = binned(left, right, keys, time, low, high, width), F.col("after")
    begins = after >= low * 1_000_000 if closed in ("both", "left") else after > low * 1_000_000
    ends = after <= high * 1_000_000 if closed in ("both", "right") else after < high * 1_000_000
    return pairs.where(begins & ends).select("l", "r")

"""As-of join: each left row with the last right row at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, bucket: Column | None = None, strict: bool = False) -> DataFrame:
    """A left join; right has one row per key and time (of several, any one is taken). No pair is made that does not match.

    Both sides are put in one frame, ordered by time, and each left row takes the last right row before it. With a bucket (a
    function of the time that never falls, such as its day) a key's rows are dealt by bucket, so that no key, however frequent, is
    sorted by one task; the last right row of each bucket, found by an aggregate, is carried on to the buckets after it. strict: the right
    row's time has to be before the left row's.
    """
    mine, other = (0, 1) if strict else (1, 0)
    values = [c for c in right.columns if c not in (*keys, time)]
    packed = right.select(*keys, time, F.struct(F.lit(True).alias("_hit"), *values).alias("_right"))
    rows = left.withColumn("_side", F.lit(mine)).unionByName(packed.withColumn("_side", F.lit(other)), allowMissingColumns=True)
    by = keys
    if bucket is not None:
        rows, by = rows.withColumn("_bucket", bucket), [*keys, "_bucket"]
    before = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_last", F.last("_right", ignorenulls=True).over(before)).where(F.col("_side") == mine)
    if bucket is not None:
        # a row for each key and bucket
        ends = rows.groupBy(*by).agg(F.max_by("_right", F.when(F.col("_side") == other, F.col(time))).alias("_end"))
        earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(c).alias(f"_carried_{c}") for c in by], F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
        same = F.lit(True)
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"_carried_{c}"))
        found = found.join(carried, same, "left").withColumn("_last", F.coalesce("_last", "_before"))
    return found.select(*left.columns, *[F.col("_last")[c].alias(c) for c in values])

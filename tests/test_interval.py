import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventide.operators.interval import binned, interval_join

T0 = datetime(2024, 1, 1)


def frames(spark, seed=1, n=150):
    rng = random.Random(seed)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, T0 + timedelta(seconds=rng.randrange(-300, 300)) if rng.random() < 0.95 else None, k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t timestamp, after int")


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
@pytest.mark.parametrize(("low", "high", "width"), [(0, 60, None), (-30, 30, 7), (20, 20, None), (-100, -40, 200)])
def test_pairs_by_hand(spark, closed, low, high, width):
    rows, frame = frames(spark)
    got = sorted(tuple(r) for r in interval_join(frame, frame, ["k"], "t", low, high, closed, width).select("l.after", "r.after").collect())
    first, last = closed in ("both", "left"), closed in ("both", "right")
    ok = lambda d: (low < d or first and low == d) and (d < high or last and d == high)
    assert got == sorted((i, j) for a, t, i in rows for b, u, j in rows if a is not None and a == b and t and u and ok((u - t).total_seconds()))


def test_a_hot_key_meets_only_its_neighbours(spark):
    """A key with a third of the rows: what is compared grows with the rows, not with their square."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    def compared(n):
        rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.timestamp_seconds(F.col("id")).alias("t"))
        pairs = binned(rows, rows, ["k"], "t", 0, 60)
        return pairs.count(), interval_join(rows, rows, ["k"], "t", 0, 60).count()

    (few, found), (more, found_more) = compared(3000), compared(12_000)
    assert more < 4.2 * few and few < 3.3 * found and found_more > 3.9 * found


def test_empty_and_backward_intervals(spark):
    _, frame = frames(spark)
    assert interval_join(frame.limit(0), frame, ["k"], "t", 0, 5).count() == 0
    with pytest.raises(ValueError):
        interval_join(frame, frame, ["k"], "t", 5, 0)

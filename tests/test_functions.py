from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventide.functions.summary import percentage, short_count, summarize
from eventide.functions.time_bucket import dynamic_width, register_time_bucket, time_bucket
from eventide.functions.time_range import QUICK_RANGES, parse_range, parse_time
from eventide.operators import predicates as P

NOW = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)


@pytest.mark.parametrize(("seconds", "width"), [(0, "10 seconds"), (-5, "10 seconds"), (1, "10 seconds"), (200, "10 seconds"), (201, "10 seconds"), (300, "10 seconds"), (900, "30 seconds"), (1800, "1 minutes"), (3600, "1 minutes"), (10_800, "5 minutes"), (21_600, "15 minutes"), (43_200, "30 minutes"), (86_400, "1 hours"), (259_200, "3 hours"), (604_800, "6 hours"), (1_728_000, "12 hours"), (1_728_001, "1 day"), (2_592_000, "1 day")])
def test_width_of_a_chart(seconds, width):
    assert dynamic_width(NOW, NOW + timedelta(seconds=seconds)) == width


def test_time_ranges():
    assert parse_time("now", NOW) == NOW and parse_time("now-90m", NOW) == NOW - timedelta(minutes=90)
    assert parse_time("2024-01-01T09:00:00+09:00", NOW) == datetime(2024, 1, 1, tzinfo=timezone.utc)
    for bad in ("now-5x", "now+5m", "yesterday", ""):
        with pytest.raises(ValueError):
            parse_time(bad, NOW)
    r = parse_range(now=NOW)
    assert r.formatted() == ("2024-05-06T06:38:09+00:00", "2024-05-06T07:08:09+00:00")
    later = NOW + timedelta(hours=1)
    assert r.refreshed(later).end == later
    fixed = parse_range("2024-01-01", "2024-01-02", NOW)
    assert fixed.refreshed(later) is fixed
    assert all(parse_time(x, NOW) < NOW for x in QUICK_RANGES)


def test_buckets_agree_in_both_forms(spark):
    register_time_bucket(spark)
    times = ["1969-12-31 23:59:59.999999", "1999-12-31 12:00:00", "2000-01-03 00:00:00", "2024-01-06 05:04:03.2", "2024-03-31 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    for width, sql in (("10 seconds", "INTERVAL '10 second'"), ("15 minutes", "INTERVAL 15 MINUTE"), ("3 hours", "INTERVAL '3 hours'"), ("1 day", "INTERVAL 1 DAY"), ("7 days", "INTERVAL 7 DAY")):
        got = df.select(time_bucket("ts", width).alias("a"), F.expr(f"time_bucket({sql}, ts)").alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), width
    assert str(df.select(time_bucket("ts", "7 days")).collect()[3][0]) == "2024-01-01 00:00:00"
    assert [str(r[0])[:10] for r in df.selectExpr("month_bucket(3, ts)").collect()] == ["1969-10-01", "1999-10-01", "2000-01-01", "2024-01-01", "2024-01-01"]
    with pytest.raises(ValueError):
        time_bucket("ts", "1 month")


def test_texts(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 999, 1000, 1_500_000)], "n long")
    assert [r[0] for r in rows.select(short_count("n")).collect()] == ["0", "999", "1.0K", "1.5M"]
    assert rows.where("n = 1500000").select(short_count("n", ((1_000, "K"),))).first()[0] == "1500.0K"
    shares = spark.createDataFrame([(1, 0), (1, 3), (2, 2)], "part long, total long").select(percentage("part", "total"))
    assert [r[0] for r in shares.collect()] == ["0%", "33.3%", "100.0%"]
    assert summarize([]) == {"ok": True, "rows": 0, "columns": [], "first": None}
    assert summarize([{"a": 1, "b": None}])["columns"] == ["a", "b"] and summarize([], "no")["error"] == "no"


def test_predicates_hold_values_apart_from_the_text(spark):
    df = spark.sql("SELECT named_struct('namespace', \"it's\") AS metadata, 'Warning' AS type, 'x' AS reason")
    assert df.where(P.namespace_warnings("it's")).count() == 1 and df.where(P.cell("metadata.namespace", "")).count() == 0
    with pytest.raises(ValueError):
        P.cell("1 = 1 OR type", "x")

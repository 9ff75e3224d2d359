import random
from datetime import timedelta

import pytest

from eventide.operators import lifecycle
from eventide.sources.sketches import approximate, in_window
from eventide.sources.store import NoDataSources

from .test_store import at, event, frame, store  # noqa: F401

HOUR = 3600


def rows(n, seed=0, hours=30):
    rng = random.Random(seed)
    return [event(f"{seed}-{k}", s := rng.randrange(hours * HOUR), rng.choice("abcd"), involvedObject={"name": f"p{rng.randrange(4000)}"}, count=rng.randrange(1, 1000), firstTimestamp=at(s - rng.randrange(100))) for k in range(n)]


def test_windows_are_merged_exactly_when_small(store, spark):
    first, second, hot = rows(150, 1), rows(120, 2), rows(60, 3)
    for part in (first, second):
        store.append(frame(spark, *part))
        lifecycle.archive(store, 0)
    store.append(frame(spark, *hot, event("none", 0, lastTimestamp=None)))
    every = first + second + hot
    for low, high in ((0, 30 * HOUR), (1234, 20 * HOUR + 1), (5 * HOUR, 6 * HOUR - 1), (5 * HOUR, 6 * HOUR), (100, 200), (7 * HOUR + 5, 9 * HOUR)):
        inside = [e for e in every if at(low) <= e["lastTimestamp"] <= at(high)]
        got = approximate(store, at(low), at(high), ["objects", "reasons"], {"count": [0.0, 1.0], "seconds": [0.5]}).first()
        assert (got["n"], got["objects_distinct"], got["reasons_distinct"]) == (len(inside), len({e["involvedObject"]["name"] for e in inside}), len({e["reason"] for e in inside}))
        if inside:
            assert got["count_quantiles"] == [min(e["count"] for e in inside), max(e["count"] for e in inside)] and 0 <= got["seconds_quantiles"][0] < 100
    got = {r["bucket"]: r["objects_distinct"] for r in approximate(store, at(0), at(30 * HOUR), ["objects"], width="3 hours").collect()}
    buckets = {}
    for e in every:
        s = int((e["lastTimestamp"] - at(0)).total_seconds()) // (3 * HOUR) * 3 * HOUR
        buckets.setdefault((at(0) + timedelta(seconds=s)).replace(tzinfo=None), set()).add(e["involvedObject"]["name"])
    assert got == {b: len(v) for b, v in buckets.items()}


def test_a_large_window_reads_sketches_and_is_within_the_bound(store, spark):
    every = rows(9000, 4, hours=10)
    store.append(frame(spark, *every))
    lifecycle.archive(store, 0)
    _, merged, scanned = in_window(store, at(0), at(10 * HOUR), ["objects"], ["count"])
    assert len(merged) == 1 and scanned == []
    _, merged, scanned = in_window(store, at(600), at(10 * HOUR), ["objects"], ["count"])
    assert len(merged) == len(scanned) == 1
    got = approximate(store, at(0), at(10 * HOUR), ["objects"], {"count": [0.1, 0.5, 0.9]}).first()
    exact, counts = len({e["involvedObject"]["name"] for e in every}), sorted(e["count"] for e in every)
    assert abs(got["objects_distinct"] - exact) <= 0.05 * exact and got["n"] == 9000
    for q, value in zip((0.1, 0.5, 0.9), got["count_quantiles"]):
        assert abs(sum(c <= value for c in counts) / len(counts) - q) < 0.027


def test_what_is_not_sketched(store, spark):
    with pytest.raises(NoDataSources):
        approximate(store, at(0), at(1), ["objects"])
    store.append(frame(spark, event(1, 5)))
    for bad in ({"distinct": ["names"]}, {"quantiles": {"size": [0.5]}}, {"width": "90 minutes"}):
        with pytest.raises(ValueError):
            approximate(store, at(0), at(9), **bad)
    assert approximate(store, at(0), at(9), ["objects"], {"count": [0.5]}).first()["count_quantiles"] == [1.0]


def test_hours_with_many_objects_are_counted_exactly(spark, tmp_path):
    """Thousands of objects an hour, where a sketch only estimates."""
    from eventide.plans import continuous

    rows = spark.range(12000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(0, int(id % 2), int(id % 60)) AS ts", "id * 7 % 9001 AS user_id", "'click' AS event_type", "1.0D AS value", "'{\"k\": 3}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["bucket"].hour: (r["n"], r["objects_distinct"], r["reasons_distinct"], r["median_count"]) for r in continuous.sketched_hours(spark, str(tmp_path)).collect()}
    assert got == {h: (6000, len({k * 7 % 9001 for k in range(h, 12000, 2)}), 1, 1.0) for h in (0, 1)}

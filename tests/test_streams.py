"""Joins and state of streams against the same rows in one batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventide.streaming.incidents import incidents, merged, with_state
from eventide.streaming.joins import followed_by

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, t timestamp, id int"


def rows(seed, n, span):
    rng = random.Random(seed)
    return [(rng.choice("abc") if rng.random() < 0.95 else None, T0 + timedelta(seconds=rng.randrange(span)) if rng.random() < 0.97 else None, seed * 10_000 + k) for k in range(n)]


def written(spark, path, *parts):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/{k:03}")
        import time

        time.sleep(0.02)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def collected(spark, frame, tmp_path, name):
    out = f"{tmp_path}/{name}"
    running = frame.writeStream.outputMode("append").option("checkpointLocation", f"{out}-offsets").format("parquet").option("path", out).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out), running


def test_pairs_of_streams_are_those_of_the_batch(spark, tmp_path):
    causes, effects = rows(1, 90, 4000), rows(2, 90, 4000)
    streams = [written(spark, f"{tmp_path}/{n}", *[part[k::3] for k in range(3)]) for n, part in (("c", causes), ("e", effects))]
    got, _ = collected(spark, followed_by(*streams, ["k"], "t", "5 MINUTES", "2 hours"), tmp_path, "pairs")
    found = sorted(tuple(r) for r in got.select("cause.id", "effect.id").collect())
    batch = followed_by(*[spark.createDataFrame(x, SCHEMA) for x in (causes, effects)], ["k"], "t", "5 MINUTES", "2 hours")
    want = sorted((i, j) for a, t, i in causes for b, u, j in effects if a and a == b and t and u and timedelta() <= u - t <= timedelta(minutes=5))
    assert found == want == sorted(tuple(r) for r in batch.select("cause.id", "effect.id").collect()) and len(want) > 50


def test_the_state_of_a_join_is_dropped(spark, tmp_path):
    """After a long silence nothing of the rows before it is left, and a row that comes too late finds no partner."""
    early = [("a", T0 + timedelta(seconds=k), k) for k in range(50)]
    far = [("a", T0 + timedelta(days=9), 100)]
    parts = (early, far, far, [("a", T0 + timedelta(seconds=60), 200)])
    streams = [written(spark, f"{tmp_path}/{n}", *parts) for n in "ce"]
    got, running = collected(spark, followed_by(*streams, ["k"], "t", "10 SECONDS", "1 minute"), tmp_path, "pairs")
    last = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    assert max(last) >= 100 and last[-1] <= 4
    assert got.where("cause.id = 200 OR effect.id = 200").count() == 0 and got.where("cause.id < 100").count() == sum(min(11, 50 - k) for k in range(50))


def test_spans_by_hand():
    assert merged([(10, 10, 1), (0, 0, 1), (14, 14, 2), (5, 5, 1)], 5) == [(0, 0, 1), (5, 5, 1), (10, 14, 3)]
    assert merged([(0, 20, 3), (5, 6, 1), (24, 24, 1)], 5) == [(0, 24, 5)] and merged([], 5) == []


def test_incidents_are_the_sessions_of_the_batch(spark, tmp_path):
    session = with_state(spark)
    held = [r for r in rows(3, 200, 20_000)]
    end = [(k, T0 + timedelta(days=30), -1) for k in ("end",)]
    stream = written(session, f"{tmp_path}/rows", held[0::3], held[1::3], held[2::3], end)
    got, running = collected(session, incidents(stream, "k", "t", 300, "1 day"), tmp_path, "incidents")
    batch = spark.createDataFrame(held, SCHEMA).where("k IS NOT NULL AND t IS NOT NULL").groupBy("k", F.session_window("t", "300 seconds")).agg(F.min("t"), F.max("t"), F.count("*"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((r[0], *r[2:]) for r in batch.collect())
    assert running.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2  # only the last event is open


def test_keys_that_share_a_state(spark, tmp_path, monkeypatch):
    """Incidents of many keys whose states are two."""
    from eventide.plans import catalog, continuous
    from eventide.streaming import incidents as module

    monkeypatch.setattr(module, "BUCKETS", 2)
    sf = "/root/testdata/sf0.001"
    got = {(r["pod"], r["first"], r["last"], r["n"]) for r in continuous.stream_incidents(spark, sf).collect()}
    times = {}
    for r in catalog.native(spark, sf).where("type = 'Warning'").select("involvedObject.name", F.col("lastTimestamp").cast("timestamp_ntz").alias("t")).collect():
        times.setdefault(r["name"], []).append(r["t"])
    expected = set()
    for pod, at in times.items():
        at.sort()
        starts = [0, *(k for k in range(1, len(at)) if at[k] - at[k - 1] >= timedelta(hours=2)), len(at)]
        expected |= {(pod, at[a], at[b - 1], b - a) for a, b in zip(starts, starts[1:])}
    assert got == expected


def test_landing_files_grow_in_number(spark, monkeypatch):
    from eventide.plans import catalog
    from eventide.sources import files

    monkeypatch.setattr(catalog, "LANDING_ROWS", 200)
    landings = lambda: {n for n in files.names_in(files.shared_dir(spark)) if n.startswith("eventide-landing")}
    before = landings()
    assert catalog.stream_ingest(spark, "/root/testdata/sf0.001").count() == 1000
    (made,) = landings() - before
    assert len(files.parts_in(f"{files.shared_dir(spark)}/{made}")) == 10

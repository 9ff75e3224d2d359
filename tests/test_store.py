import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventide.dialect import with_view
from eventide.engine import Engine, NotAQuery, TooManyRows
from eventide.operators import lifecycle
from eventide.operators.asof import asof_join
from eventide.sources.schema import EVENT_SCHEMA, conform, normalise
from eventide.sources.store import ARCHIVE, HOT, EventStore, NoDataSources, Segment

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def event(key, seconds, reason="BackOff", kind="Warning", namespace="ns", **more):
    row = {"kind": "Event", "metadata": {"name": f"e{key}", "namespace": namespace, "resourceVersion": None if key is None else str(key), "creationTimestamp": at(seconds)}, "reason": reason, "type": kind, "lastTimestamp": at(seconds), "firstTimestamp": at(seconds), "count": 1}
    return row | more


def frame(spark, *events):
    return spark.createDataFrame(list(events), EVENT_SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, f"file://{tmp_path}/store")


def keys(df):
    return sorted(r[0] for r in df.select("metadata.resourceVersion").collect())


def test_normalisation(spark):
    zero = datetime(1, 1, 2, tzinfo=timezone.utc)
    rows = frame(spark, event(1, 5, firstTimestamp=None, lastTimestamp=None, count=0), event(2, 5, firstTimestamp=at(3), lastTimestamp=None, count=None), event(3, 5, count=7), event(4, 9, eventTime=zero))
    out = {r["metadata"]["resourceVersion"]: r for r in normalise(rows).drop("eventTime").collect()}
    naive = lambda s: at(s).replace(tzinfo=None)
    assert (out["1"]["firstTimestamp"], out["1"]["lastTimestamp"], out["1"]["count"]) == (naive(5), naive(5), 1)
    assert (out["2"]["lastTimestamp"], out["2"]["count"], out["3"]["count"]) == (naive(3), 1, 7)


def test_conform_fills_missing_columns(spark):
    rows = spark.sql("SELECT named_struct('resourceVersion', '7') AS metadata, 'x' AS extra")
    got = conform(rows)
    assert got.schema.names == EVENT_SCHEMA.names
    assert got.select("metadata.resourceVersion", "metadata.name", "reason", "related").first() == ("7", None, None, None)


def test_first_of_a_key_wins(store, spark):
    assert store.append(frame(spark, event(1, 10, "a"), event(1, 10, "b"), event(2, 20), event(None, 5), event(None, 5)).coalesce(1)) == 4
    assert store.append(frame(spark, event(1, 10, "c"), event(3, 15))) == 1
    lifecycle.archive(store, 0)
    assert store.append(frame(spark, event(2, 20), event(3, 15), event(4, -3600))) == 1
    got = {r["metadata"]["resourceVersion"]: r["reason"] for r in store.events(at(-9999), at(9999))[0].collect()}
    assert got["1"] == "a" and set(got) == {"1", "2", "3", "4", None}


def test_a_repeated_batch_changes_nothing(store, spark):
    rows = frame(spark, event(1, 10), event(2, 20))
    assert [store.append(rows, "s", 0), store.append(rows, "s", 0), store.append(rows, "s", 1)] == [2, 0, 0]
    assert store.manifest().batches == {"s": 1} and store.append(rows.limit(0), "s", 2) == 0


def test_window_ends_are_inclusive_and_prune(store, spark):
    for k, s in enumerate((0, 100, 200)):
        store.append(frame(spark, event(k, s), event(10 + k, s + 50)))
    df, read = store.events(at(50), at(100))
    assert keys(df) == ["1", "10"] and len(read) == 2
    with pytest.raises(NoDataSources):
        store.events(at(51), at(99))
    with pytest.raises(NoDataSources):
        store.events(at(5000), at(6000))
    lifecycle.archive(store, 0)
    store.append(frame(spark, event(99, 60)))
    assert keys(store.events(at(55), at(65))[0]) == ["99"]  # late, and still there
    assert keys(store.events(at(55), at(65), elide_hot=True)[0]) == []


def test_segments_without_bounds_are_always_read(store, spark):
    store.append(frame(spark, event(1, 10, lastTimestamp=None), event(2, 10)))
    assert store.manifest().segments[0].min_us is None
    assert keys(store.events(at(0), at(20))[0]) == ["2"]


@pytest.mark.parametrize("seed", range(3))
def test_any_history_gives_the_same_events(store, spark, seed):
    rng = random.Random(seed)
    rows = [event(k, rng.randrange(1000)) for k in range(60)]
    rng.shuffle(rows)
    for part in (rows[:20], rows[10:35], rows[35:]):
        store.append(frame(spark, *part))
        for step in (lambda: lifecycle.archive(store, rng.choice([0, 30])), lambda: lifecycle.compact(store)):
            if rng.random() < 0.7:
                step()
    lifecycle.tick(store, grace=0)
    got = keys(store.events(at(0), at(1000))[0])
    assert got == sorted(str(k) for k in range(60))
    assert len(store.manifest().segments) == len([n for n in __import__("eventide.sources.files", fromlist=["x"]).names_in(f"{store.root}/segments")])


def segment(name, size, low=0, high=1, tier=ARCHIVE, rows=1):
    return Segment(name, tier, rows, size, low, high)


def test_plans():
    mb = 1 << 20
    hot = [segment("a", 1, tier=HOT, rows=122_880)]
    assert not lifecycle.plan_archive(hot) and lifecycle.plan_archive([*hot, segment("b", 1, tier=HOT)])
    ids = lambda plans: [[s.id for s in p] for p in plans]
    small = [segment(n, 70 * mb, k) for k, n in enumerate("abc")]
    assert ids(lifecycle.plan_compaction([*small, segment("x", 128 * mb, 9)])) == [["a", "b", "c"]]
    assert ids(lifecycle.plan_compaction([segment("a", mb, 0), segment("b", mb, 1), segment("x", 128 * mb, 2), segment("c", mb, 3), segment("d", mb, 4)])) == [["c", "d"]]
    assert ids(lifecycle.plan_compaction([segment("a", mb)])) == []
    gone = lifecycle.plan_retention([segment("b", 6, 5), segment("a", 6, 1), segment("h", 6, 0, tier=HOT)], 12)
    assert [s.id for s in gone] == ["a"] and not lifecycle.plan_retention([segment("a", 6)], 6)


def test_retention_drops_the_oldest(store, spark):
    for k in range(3):
        store.append(frame(spark, event(k, 100 * k)))
        lifecycle.archive(store, 0)
    sizes = [s.bytes for s in store.manifest().segments]
    assert lifecycle.retain(store, sum(sizes) - 1) == 1
    assert keys(store.events(at(0), at(999))[0]) == ["1", "2"]


def test_only_tokens_are_replaced():
    text = "SELECT '$events', \"$events\" FROM $events a JOIN $events -- $events\n /* $events */ USING (x);"
    assert with_view(text) == "SELECT '$events', \"$events\" FROM window_events a JOIN window_events -- $events\n /* $events */ USING (x)"


def test_queries(store, spark):
    store.append(frame(spark, event(1, 0), event(2, 60, kind="Normal", eventTime=datetime(1, 1, 2, tzinfo=timezone.utc)), event(3, 60, namespace="it's")))
    engine = Engine(spark, store)
    ask = lambda sql: engine.query(sql, at(0), at(60))
    result = ask('SELECT type, COUNT(*) as count FROM $events GROUP BY type ORDER BY count DESC;')
    assert result.results == [{"type": "Warning", "count": 2}, {"type": "Normal", "count": 1}]
    assert result.total_files_size_bytes == sum(f["size"] for f in result.files) > 0 and result.duration_ms >= 0
    assert ask('SELECT "count" FROM $events LIMIT 1').results == [{"count": 1}]
    assert ask("SELECT metadata.namespace FROM $events WHERE metadata.namespace LIKE 'it''s'").results == [{"namespace": "it's"}]
    assert ask("WITH a AS (SELECT * FROM $events) SELECT count(*) AS n FROM a JOIN $events b USING (kind)").results == [{"n": 9}]
    assert ask("SELECT * FROM $events WHERE reason = 'none'").results == []
    assert ask("SELECT eventTime FROM $events WHERE eventTime IS NOT NULL").results[0]["eventTime"].startswith("0001-01-02")
    assert ask("SELECT time_bucket(INTERVAL 1 MINUTE, lastTimestamp) AS b, count(*) AS n FROM $events GROUP BY 1 ORDER BY 1").results == [{"b": "2024-01-01T00:00:00.000000Z", "n": 1}, {"b": "2024-01-01T00:01:00.000000Z", "n": 2}]
    spark.range(1).createOrReplaceTempView("elsewhere")
    spark.range(1).createOrReplaceGlobalTempView("everywhere")
    with pytest.raises(NotAQuery):
        engine.ordered(at(0), at(60), "reason = java_method('java.lang.System', 'getProperty', 'user.home')")
    assert engine.query("SELECT * FROM $events", at(0), at(60), most_rows=3).results[2]
    with pytest.raises(TooManyRows):
        engine.query("SELECT * FROM $events", at(0), at(60), most_rows=2)
    for bad in ("DROP VIEW window_events", "SET a=b", "CREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", "INSERT INTO window_events SELECT * FROM $events", f"SELECT * FROM parquet.`{store.path(store.manifest().segments[0].id)}`", "SELECT * FROM elsewhere", "SELECT 1 AS a, 2 AS a FROM $events", "SHOW TABLES", "x", "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS x FROM $events", "SELECT 1 AS a FROM $events WHERE IDENTIFIER('refl' || 'ect')('java.lang.System', 'getProperty', 'user.home') = 'x'", "SELECT * FROM $events WHERE reason IN (SELECT try_reflect('java.lang.System', 'getProperty', 'user.home'))", "SELECT * FROM global_temp.everywhere", "SELECT * FROM $events WHERE EXISTS (SELECT 1 FROM global_temp.everywhere)"):
        with pytest.raises(NotAQuery):
            ask(bad)


def test_export_and_stats(store, spark, tmp_path):
    import gzip
    import json

    store.append(frame(spark, *[event(k, 100 - k, "a" if k % 2 else "b") for k in range(20)]))
    engine = Engine(spark, store)
    assert engine.export(f"{tmp_path}/out.gz", at(0), at(200), "reason = 'a'") == 10
    rows = [json.loads(x) for x in gzip.open(f"{tmp_path}/out.gz", "rt")]
    assert [r["lastTimestamp"] for r in rows] == sorted(r["lastTimestamp"] for r in rows) and "related" in rows[0]
    assert engine.export_files(f"file://{tmp_path}/parts", at(0), at(200)) == 20
    assert spark.read.text(f"file://{tmp_path}/parts").count() == 20
    stats = engine.stats()
    assert stats["memory"][0]["most"] > 0 and stats["temporary_files"]["bytes"] >= 0
    assert stats["rows"] == {"hot": 20} and stats["data_dir_size"] > 0 and stats["errors"] == []


def test_a_download_is_one_file_of_many_members(store, spark, tmp_path, monkeypatch):
    import gzip
    import io
    import json

    from eventide.sources import files

    for part in range(3):
        store.append(frame(spark, *[event(f"{k:04}", (k * 37) % 500) for k in range(part, 600, 3)]))
    monkeypatch.setitem(__import__("eventide.session", fromlist=["x"]).SETTINGS, "spark.sql.adaptive.enabled", "false")
    engine, out = Engine(spark, store), io.BytesIO()
    made = []
    usual = files.new_path
    monkeypatch.setattr(files, "new_path", lambda *a: made.append(usual(*a)) or made[-1])
    with engine.members(at(0), at(500)) as found:
        assert len(found.parts) > 1 and found.rows == 600
        found.pass_on(out)
        assert found.size == len(out.getvalue())
    assert files.parts_in(made[0]) == []
    rows = [json.loads(x) for x in gzip.decompress(out.getvalue()).splitlines()]
    places = [(r["lastTimestamp"], r["metadata"]["resourceVersion"]) for r in rows]
    assert len(places) == 600 and places == sorted(places)
    assert engine.export(f"{tmp_path}/none.gz", at(0), at(500), "reason = 'none'") == 0 and gzip.open(f"{tmp_path}/none.gz").read() == b""


def test_http(store, spark):
    import gzip
    import json
    import threading
    import urllib.error
    import urllib.request

    from eventide.server import serve

    store.append(frame(spark, event(1, 0), event(2, 60)))
    server = serve(Engine(spark, store), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(base + path, json.dumps(body).encode() if body is not None else None) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    window = {"start": at(0).isoformat(), "end": at(60).isoformat()}
    code, body = ask("/query", {"query": "SELECT count(*) AS n FROM $events", **window})
    assert code == 200 and json.loads(body)["results"] == [{"n": 2}]
    assert ask("/query", {"query": "", **window})[0] == ask("/query", {"query": "x"})[0] == 400
    assert ask("/query", {"query": "DROP TABLE x", **window})[0] == 500
    with urllib.request.urlopen(urllib.request.Request(f"{base}/query", method="OPTIONS")) as r:
        assert r.status == 204 and "POST" in r.headers["Access-Control-Allow-Methods"] and r.headers["Access-Control-Allow-Headers"] == "Content-Type"
    assert ask("/query")[0] == 405 and ask("/none")[0] == 404 and ask("/download")[0] == 400
    code, body = ask("/download?from=2024-01-01T00:00:00Z&to=2024-01-01T00:00:30Z")
    assert code == 200 and len(gzip.decompress(body).splitlines()) == 1
    assert json.loads(ask("/stats")[1])["rows"] == {"hot": 2} and ask("/metrics")[0] == 200
    server.shutdown()


def test_streaming_ingest_keeps_late_events(store, spark, tmp_path):
    from eventide.streaming.ingest import CollectedCounter, ingest, landing

    counter = CollectedCounter()
    spark.streams.addListener(counter)
    folder = f"{tmp_path}/landing"
    run = lambda: ingest(landing(spark, folder, 1), store, f"{tmp_path}/offsets", once=True).awaitTermination()
    for part in ([event(1, 5000), event(2, 5001)], [event(1, 5000), event(3, 0)]):
        frame(spark, *part).coalesce(1).write.mode("append").json(folder)
        run()
    spark.streams.removeListener(counter)
    assert keys(store.events(at(0), at(9999))[0]) == ["1", "2", "3"]
    assert store.manifest().batches["ingest"] == 1


def test_words_are_spelt_as_spark_has_them():
    text = "SELECT arg_max(a, b), 'arg_max(x)', list_contains(c, 1), length(d), time_bucket(INTERVAL '2 years', t), time_bucket(INTERVAL 1 month, t) FROM $events WHERE t > TIMESTAMPTZ '2024-01-01' -- epoch(t)"
    assert with_view(text) == "SELECT max_by(a, b), 'arg_max(x)', array_contains(c, 1), length(d), month_bucket(24, t), month_bucket(1, t) FROM window_events WHERE t > TIMESTAMP '2024-01-01' -- epoch(t)"


def test_the_limit_comes_from_the_environment():
    assert lifecycle.limit_bytes({"STORAGE_LIMIT_GB": "1.5"}) == 3 << 29 and lifecycle.limit_bytes({}) == lifecycle.LIMIT_BYTES


def between(monkeypatch, store, step):
    """Runs a step once, after the store has written its next segment and before it is published."""
    usual, done = store.write_segment, []

    def write(*args):
        out = usual(*args)
        if not done:
            done.append(1)
            step()
        return out

    monkeypatch.setattr(store, "write_segment", write)


@pytest.mark.parametrize("step", ["archive", "append", "compact", "retain", "tick"])
def test_an_append_meets_another_writer(store, spark, monkeypatch, step):
    for k in range(3):
        store.append(frame(spark, event(k, 10 + k)))
        lifecycle.archive(store, 0)
    store.append(frame(spark, event(7, 12)))
    other = EventStore(spark, store.root)
    steps = {"archive": lambda: lifecycle.archive(other, 0), "append": lambda: other.append(frame(spark, event(8, 12), event(20, 11))), "compact": lambda: lifecycle.compact(other), "retain": lambda: lifecycle.retain(other, other.manifest().segments[0].bytes), "tick": lambda: lifecycle.tick(other)}
    between(monkeypatch, store, steps[step])
    added = store.append(frame(spark, event(8, 12), event(7, 12), event(1, 11)), "s", 0)
    got = keys(store.events(at(0), at(99))[0])
    assert len(got) == len(set(got)) and {"7", "8"} <= set(got) and added == {"append": 0, "retain": 2}.get(step, 1)
    assert store.manifest().batches == {"s": 0}
    if step == "append":
        assert "20" in got
    if step != "retain":
        assert {"0", "1", "2"} <= set(got)


@pytest.mark.parametrize("step", ["append", "archive", "retain"])
def test_a_merge_meets_another_writer(store, spark, monkeypatch, step):
    store.append(frame(spark, event(1, 10)))
    store.append(frame(spark, event(2, 20)))
    other = EventStore(spark, store.root)
    steps = {"append": lambda: other.append(frame(spark, event(3, 15))), "archive": lambda: lifecycle.archive(other, 0), "retain": lambda: (lifecycle.archive(other, 0), lifecycle.retain(other, 0))}
    between(monkeypatch, store, steps[step])
    merged = lifecycle.archive(store, 0)
    assert (merged is None) == (step != "append")
    store.append(frame(spark, event(9, 12)))
    assert keys(store.events(at(0), at(99))[0]) == {"append": ["1", "2", "3", "9"], "archive": ["1", "2", "9"], "retain": ["9"]}[step]


def test_writers_in_threads_lose_nothing(store, spark):
    import threading

    errors = []

    def run(what):
        try:
            what()
        except Exception as error:
            errors.append(error)

    def appends(first):
        for k in range(3):
            EventStore(spark, store.root).append(frame(spark, event(first + k, k), event(100 + k, k)), f"t{first}", k)

    work = [lambda: appends(0), lambda: appends(10), lambda: [lifecycle.tick(EventStore(spark, store.root), grace=600) or lifecycle.archive(EventStore(spark, store.root), 0) for _ in range(3)]]
    threads = [threading.Thread(target=run, args=(w,)) for w in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []
    assert keys(store.events(at(0), at(99))[0]) == sorted(map(str, [0, 1, 2, 10, 11, 12, 100, 101, 102]))


def test_vacuum_keeps_what_may_be_in_use(store, spark):
    store.append(frame(spark, event(1, 10)))
    store.append(frame(spark, event(2, 20)))
    before, _ = store.events(at(0), at(99))
    lifecycle.archive(store, 0)
    staged = store.write_segment(conform(frame(spark, event(3, 30))), HOT)
    assert store.vacuum() == 0 and keys(before) == ["1", "2"]
    assert store.vacuum(grace=0) == 3 and len(store.versions()) <= 2 and store.manifest().dropped == {}
    assert keys(store.events(at(0), at(99))[0]) == ["1", "2"] and staged.id not in [s.id for s in store.manifest().segments]


@pytest.mark.parametrize("bucket", [None, "floor(t / 3)", "1"])
def test_asof_by_hand(spark, bucket):
    rng = random.Random(5)
    left = [(rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(40), k) for k in range(120)]
    right = list({(rng.choice("abd"), rng.randrange(40)): (k, None)[k % 7 == 0] for k in range(60)}.items())
    held = [(k, t, v) for (k, t), v in right]
    got = asof_join(spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(held, "k string, t int, v int"), ["k"], "t", bucket and F.expr(bucket))
    expected = {i: max(((u, v) for j, u, v in held if j == k and u <= t), default=(0, None), key=lambda x: x[0])[1] for k, t, i in left}
    assert {r["id"]: r["v"] for r in got.collect()} == expected


def test_asof(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 7, "z"), ("b", 10, "w")], "k string, t int, v string")
    assert {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "t").collect()} == {1: "y", 2: None, 3: None}


def test_plans_push_filters_down(store, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    store.append(frame(spark, event(1, 0)))
    df = store.events(at(0), at(60))[0].where(F.col("metadata.namespace") == "ns").groupBy("reason").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lastTimestamp" in plan and "EqualTo(metadata.namespace,ns)" in plan and "message" not in plan.split("ReadSchema")[1]


def physical(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_no_task_sorts_a_whole_file(store, spark, monkeypatch):
    """Rows are dealt before an aggregate sorts them, and the pieces of a merge are bounded in rows."""
    from eventide.operators.ingest import first_per_key, new_keys
    from eventide.sources.keys import key_filter
    from eventide.sources import files

    store.append(frame(spark, *[event(k, k) for k in range(90)]))
    (segment,) = store.manifest().segments
    rows, keys = store.rows_of(segment.id), store.keys_of(segment.id)
    assert "Sort" not in physical(first_per_key(rows, "metadata.resourceVersion")).rpartition("Exchange")[2]
    assert "Broadcast" not in physical(new_keys(rows, keys, "metadata.resourceVersion", "key"))
    assert key_filter(keys, "s", 2048).rdd.getNumPartitions() == 8
    monkeypatch.setattr(lifecycle, "PIECE_ROWS", 30)
    merged = lifecycle.archive(store, 0)
    assert len(files.parts_in(store.path(merged.id))) == 3 and store.rows_of(merged.id).count() == 90

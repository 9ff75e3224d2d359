"""Registered queries of what runs around the store: normalisation, lifecycle plans, time ranges, and the service's answers."""

from __future__ import annotations

import json
import threading
import urllib.request
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine, json_rows
from ..functions.summary import summarize
from ..functions.time_bucket import dynamic_width
from ..functions.time_range import QUICK_RANGES, parse_range
from ..operators.lifecycle import archive, compact, plan_archive, retain
from ..operators.timeline import timeline
from ..server import serve
from ..sources.bridge import BRIDGE_SQL
from ..sources.files import new_path
from ..sources.schema import EVENT_SCHEMA, normalise
from ..sources.store import ARCHIVE, HOT, EventStore
from ..streaming.ingest import CollectedCounter, ingest, landing
from .catalog import END, FLAT_SQL, RV, START, STORED_SQL, TIME, flat, loaded_store, native, query, stored, weekly_store
from .continuous import FLAT_TEXT

NOW = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)


def zoneless(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    "normalised",
    f"WITH {BRIDGE_SQL} SELECT rv, ts AS first, ts AS last, CAST(CASE WHEN event_id % 5 < 2 THEN 1 ELSE event_id % 5 END AS INTEGER) AS n FROM e",
)
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some lack the last time, some both times, some have the zero time, and some the count 0 or none."""
    part = F.pmod(F.col(RV).cast("long"), F.lit(5)).cast("int")
    zero = F.lit("0001-01-01 00:00:00").cast("timestamp")
    rows = native(spark, sf_dir).withColumn("metadata", F.col("metadata").withField("creationTimestamp", F.col(TIME)))
    rows = rows.withColumns({TIME: F.when(part == 1, F.lit(None)).when(part == 2, zero).when(part == 3, F.lit(None)).otherwise(F.col(TIME)), "firstTimestamp": F.when(part == 3, F.lit(None)).when(part == 4, zero).otherwise(F.col("firstTimestamp"))})
    rows = normalise(rows.withColumn("count", F.when(part == 0, F.lit(None)).when(part == 1, 0).otherwise(part)))
    return zoneless(rows.select(F.col(RV).alias("rv"), F.col("firstTimestamp").alias("first"), F.col(TIME).alias("last"), F.col("count").alias("n")), "first", "last")


@query("retention_oldest", f"{STORED_SQL} WHERE ts >= TIMESTAMP '2024-01-08 00:00:00'")
def retention_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte more than the limit: the oldest archived week goes."""
    store = weekly_store(spark, sf_dir, archived=True)
    retain(store, sum(s.bytes for s in store.manifest().segments) - 1)
    return stored(store)


@query("archive_threshold", f"WITH {BRIDGE_SQL} SELECT 'below' AS threshold, 'hot' AS tier, count(*) AS n FROM e UNION ALL SELECT 'above', 'archive', count(*) FROM e")
def archive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by tier, with as many hot rows as the threshold, and with one more."""
    store = loaded_store(spark, sf_dir, 2)
    n, found = sum(s.rows for s in store.manifest().segments), []
    for name, threshold in (("below", n), ("above", n - 1)):
        archive(store, threshold)
        found += [(name, tier, rows) for tier in (HOT, ARCHIVE) if (rows := sum(s.rows for s in store.manifest().segments if s.tier == tier))]
    listed = spark.createDataFrame(found, "threshold string, tier string, listed long")
    held = store.events(START, END)[0].agg(F.count("*").alias("n"))
    return listed.join(F.broadcast(held), F.col("listed") == F.col("n")).select("threshold", "tier", "n")


@query("archive_sorted", f"WITH {BRIDGE_SQL} SELECT count(*) AS n, 0 AS overlapping FROM e")
def archive_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged segment's files hold ranges of time that do not overlap."""
    store = weekly_store(spark, sf_dir, archived=True)
    compact(store)
    rows = store.rows_of(*[s.id for s in store.manifest().segments])
    parts = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min(TIME).alias("low"), F.max(TIME).alias("high"))
    parts = parts.alias("a").join(parts.alias("b"), F.expr("a.file <> b.file AND a.low < b.high AND b.low < a.high"), "left")  # a row for each file
    return parts.groupBy("a.file").agg(F.first("a.n").alias("n"), F.count("b.file").alias("meets")).agg(F.sum("n").alias("n"), F.sum("meets").cast("int").alias("overlapping"))


@query("segment_bytes", f"WITH {BRIDGE_SQL} SELECT count(*) AS n, TRUE AS sized FROM e")
def segment_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that the manifest lists are those of the files that a window reads."""
    store = weekly_store(spark, sf_dir, archived=True)
    rows, segments = store.events(START, END)
    files = rows.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size").alias("bytes"))
    return rows.agg(F.count("*").alias("n")).crossJoin(files).select("n", (F.col("bytes") == sum(s.bytes for s in segments)).alias("sized"))  # one row each


def _ladder(name: str, hours: int, width: str) -> None:
    start = NOW - timedelta(hours=hours)
    within = f"ts BETWEEN TIMESTAMP '{start:%Y-%m-%d %H:%M:%S}' AND TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"

    @query(name, f"WITH {BRIDGE_SQL} SELECT time_bucket(INTERVAL '{width}', ts) AS bucket, type, count(*) AS \"count\" FROM e WHERE {within} GROUP BY 1, 2")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, _ = loaded_store(spark, sf_dir, 1).events(start, NOW)
        return zoneless(timeline(events, dynamic_width(start, NOW)), "bucket")


for _name, _hours, _width in (("ladder_1d", 24, "1 hour"), ("ladder_3d", 72, "3 hours"), ("ladder_7d", 168, "6 hours"), ("ladder_19d", 456, "12 hours")):
    _ladder(_name, _hours, _width)


@query(
    "quick_ranges",
    f"WITH {BRIDGE_SQL}, r AS (SELECT unnest(['now-5m', 'now-15m', 'now-30m', 'now-1h', 'now-3h', 'now-6h', 'now-12h', 'now-24h', 'now-3d', 'now-7d', 'now-30d']) AS range, unnest([5, 15, 30, 60, 180, 360, 720, 1440, 4320, 10080, 43200]) AS minutes) "
    "SELECT range, count(ts) AS n FROM r LEFT JOIN e ON ts BETWEEN TIMESTAMP '2024-01-20 12:00:00' - to_minutes(minutes) AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1",
)
def quick_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in each of the ranges that the dashboard offers, in one pass over the longest, refreshed to a later now."""
    ranges = [parse_range(text, "now", NOW - timedelta(hours=5)).refreshed(NOW) for text in QUICK_RANGES]
    longest = min(ranges, key=lambda r: r.start)
    events, _ = loaded_store(spark, sf_dir, 1).events(longest.start, longest.end)
    counts = [F.count_if(F.col(TIME).between(F.timestamp_seconds(F.lit(int(r.start.timestamp()))), F.timestamp_seconds(F.lit(int(r.end.timestamp()))))).alias(r.raw_from) for r in ranges]
    return events.agg(*counts).unpivot([], [F.col(f"`{r.raw_from}`") for r in ranges], "range", "n")


@query("backpressure", f"WITH {BRIDGE_SQL} SELECT count(*) AS n, 3 AS batches, 2 AS most_files FROM e")
def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six files, of which a micro-batch takes two."""
    folder, store = new_path(spark, "landing"), EventStore(spark, new_path(spark, "store"))
    native(spark, sf_dir).repartition(6, RV).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    running = ingest(landing(spark, folder, 2), store, new_path(spark, "offsets"), once=True)
    running.awaitTermination()
    batches = sum(p["numInputRows"] > 0 for p in running.recentProgress)
    return store.events(START, END)[0].agg(F.count("*").alias("n"), F.lit(batches).alias("batches"), F.lit(2).alias("most_files"))


@query("json_answer", STORED_SQL)
def json_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's rows as the JSON of an answer, read again; nulls are there too."""
    text = f"WITH {FLAT_TEXT} SELECT rv AS resource_version, ns AS namespace, pod AS object, e.reason, e.type, ts AS last_timestamp, e.h.host AS host, NULL AS none FROM (SELECT e.*, s.source AS h FROM e JOIN $events s ON s.metadata.resourceVersion = rv) e"
    frame, _ = Engine(spark, loaded_store(spark, sf_dir, 1)).frame(text, START, END)
    rows = json_rows(frame).where("value LIKE '%\"none\":null%'").select(F.from_json("value", "resource_version string, namespace string, object string, host string, reason string, type string, last_timestamp timestamp").alias("r"))
    return zoneless(rows.select("r.*"), "last_timestamp")


def _served(name: str, sql: str) -> Callable:
    """A query over what the running service answers; answers have a row for each group, and downloads are read by Spark."""

    def registered(use: Callable[[SparkSession, EventStore, Callable], DataFrame]) -> Callable:
        @query(name, sql)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            store = loaded_store(spark, sf_dir, 1)
            server = serve(Engine(spark, store), 0, CollectedCounter())
            threading.Thread(target=server.serve_forever, daemon=True).start()

            def ask(path: str, body: dict | None = None) -> bytes:
                url = f"http://127.0.0.1:{server.server_port}{path}"
                with urllib.request.urlopen(urllib.request.Request(url, None if body is None else json.dumps(body).encode())) as answer:
                    return answer.read()

            try:
                return use(spark, store, ask)
            finally:
                server.shutdown()
                server.server_close()

        return run

    return registered


@_served("http_query", f"WITH {BRIDGE_SQL} SELECT reason, count(*) AS n FROM e GROUP BY 1")
def http_query(spark: SparkSession, store: EventStore, ask: Callable) -> DataFrame:
    answer = json.loads(ask("/query", {"query": "SELECT reason, count(*) AS n FROM $events GROUP BY reason", "start": START.isoformat(), "end": END.isoformat()}))
    return spark.createDataFrame([(r["reason"], r["n"]) for r in answer["results"]], "reason string, n long")


@_served("http_summary", f"WITH {BRIDGE_SQL} SELECT count(DISTINCT ns) AS rows, 'ns,n' AS columns, min(ns) AS first FROM e")
def http_summary(spark: SparkSession, store: EventStore, ask: Callable) -> DataFrame:
    """What a model is told of an answer."""
    answer = json.loads(ask("/query", {"query": "SELECT metadata.namespace AS ns, count(*) AS n FROM $events GROUP BY 1 ORDER BY 1", "start": START.isoformat(), "end": END.isoformat()}))
    told = summarize(answer["results"])
    return spark.createDataFrame([(told["rows"], ",".join(told["columns"]), told["first"]["ns"])], "rows long, columns string, first string")


@_served("http_download", f"WITH {BRIDGE_SQL} SELECT {FLAT_SQL} FROM e WHERE reason = 'OOMKilling'")
def http_download(spark: SparkSession, store: EventStore, ask: Callable) -> DataFrame:
    """One gzipped file, as a client would keep it, read by Spark."""
    from ..sources.files import place

    body = ask(f"/download?from={START.isoformat()}&to={END.isoformat()}&where={quote("reason = 'OOMKilling'")}")
    folder = new_path(spark, "downloaded")
    fs, at = place(folder)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/events.jsonl.gz", compression=None) as out:
        out.write(body)
    return zoneless(flat(spark.read.schema(EVENT_SCHEMA).json(folder)), "last_timestamp")


@_served("http_stats", f"WITH {BRIDGE_SQL} SELECT 'hot' AS tier, count(*) AS n FROM e")
def http_stats(spark: SparkSession, store: EventStore, ask: Callable) -> DataFrame:
    return spark.createDataFrame(list(json.loads(ask("/stats"))["rows"].items()), "tier string, n long")


@query("http_metrics", f"WITH {BRIDGE_SQL} SELECT 'events_collected_total' AS metric, 2 * count(*) AS n FROM e")
def http_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter has every event that came in; here each came twice."""
    counter, folder, store = CollectedCounter(), new_path(spark, "landing"), EventStore(spark, new_path(spark, "store"))
    for _ in range(2):
        native(spark, sf_dir).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    spark.streams.addListener(counter)
    try:
        running = ingest(landing(spark, folder), store, new_path(spark, "offsets"), once=True)
        running.awaitTermination()
        told = sum(p["numInputRows"] for p in running.recentProgress)
        for _ in range(100):  # progress reaches listeners a little later
            if counter.total >= told:
                break
            threading.Event().wait(0.05)
    finally:
        spark.streams.removeListener(counter)
    name, value = counter.exposition().splitlines()[-1].split()
    return spark.createDataFrame([(name, int(value))], "metric string, n long")


@query("hot_rows_below_threshold", f"WITH {BRIDGE_SQL} SELECT count(*) AS n, count(*) > 122880 AS due FROM e")
def hot_rows_below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an archive is due by the usual threshold."""
    store = loaded_store(spark, sf_dir, 1)
    return store.events(START, END)[0].agg(F.count("*").alias("n"), F.lit(bool(plan_archive(store.manifest().segments))).alias("due"))

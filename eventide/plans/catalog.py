"""The registry of queries, each with the SQL by which it is checked."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.summary import percentage, short_count
from ..functions.time_bucket import time_bucket
from ..operators import predicates as P
from ..operators.asof import asof_join
from ..operators.ingest import first_per_key
from ..operators.interval import interval_join
from ..operators.lifecycle import archive, compact
from ..operators.timeline import reason_severity, share_of_largest, timeline, timeline_shares, timeline_wide
from ..session import request_session
from ..sources.bridge import BRIDGE_SQL, bridged
from ..sources.files import new_path
from ..sources.schema import conform
from ..sources.store import ARCHIVE, EventStore, NoDataSources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TIME, RV, NS = "lastTimestamp", "metadata.resourceVersion", "metadata.namespace"
START, END = datetime(2024, 1, 1), datetime(2024, 2, 1)


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def registered(run: Query) -> Query:
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return registered


def on_events(name: str, sql: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """A query over all bridged events."""
    QUERIES[name] = lambda spark, sf_dir: build(bridged(spark, sf_dir))
    ORACLES[name] = f"WITH {BRIDGE_SQL} {sql}"


def on_tables(name: str, sql: str, build: Callable[..., DataFrame], *tables: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
    ORACLES[name] = sql


def count_as(name: str) -> Column:
    return F.count("*").alias(name)


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- metric cards -----------------------------------------------------------------------------

on_events("total_events", "SELECT count(*) AS total_count FROM e", lambda e: e.agg(count_as("total_count")))
on_events(
    "error_rate",
    "SELECT CAST(sum(CASE WHEN type = 'Warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning_count, count(*) AS total_count FROM e",
    lambda e: e.agg(F.sum(F.when(P.warning(), 1).otherwise(0)).alias("warning_count"), count_as("total_count")),
)
for _name, _card, _where in (
    ("failed_pods", "failed_pods", f"reason IN ({quoted(P.FAILED_PODS)})"),
    ("restarts", "restarts", "reason = 'BackOff'"),
    ("node_issues", "node_issues", f"type = 'Warning' AND reason IN ({quoted(P.NODE_ISSUES)})"),
    ("network_events", "network", f"type = 'Warning' AND reason IN ({quoted(P.NETWORK)})"),
    ("storage_events", "storage", f"type = 'Warning' AND reason IN ({quoted(P.STORAGE)})"),
):
    on_events(_name, f"SELECT count(*) AS {_name}_count FROM e WHERE {_where}", lambda e, n=_name, c=_card: e.where(P.metric_card(c)).agg(count_as(f"{n}_count")))

# --- rows -------------------------------------------------------------------------------------

FLAT = {"resource_version": RV, "namespace": NS, "object": "involvedObject.name", "host": "source.host", "reason": "reason", "type": "type", "last_timestamp": TIME}
FLAT_SQL = "rv AS resource_version, ns AS namespace, pod AS object, host, reason, type, ts AS last_timestamp"


def flat(events: DataFrame) -> DataFrame:
    return events.select(*[F.col(c).alias(n) for n, c in FLAT.items()])


def newest(events: DataFrame, n: int) -> DataFrame:
    return flat(events).orderBy(F.desc("last_timestamp"), "resource_version").limit(n)


on_events("latest_100", f"SELECT {FLAT_SQL} FROM e ORDER BY ts DESC, rv LIMIT 100", lambda e: newest(e, 100))
on_events(
    "recent_critical_20",
    "SELECT ts AS \"creationTimestamp\", type, reason, ns AS namespace, 'Pod' AS object_kind, pod AS object_name, reason || ' on ' || pod AS message FROM e WHERE type = 'Warning' ORDER BY ts DESC, rv LIMIT 20",
    lambda e: e.where(P.warning()).orderBy(F.desc(TIME), RV).limit(20).select(F.col(TIME).alias("creationTimestamp"), "type", "reason", F.col(NS).alias("namespace"), F.col("involvedObject.kind").alias("object_kind"), F.col("involvedObject.name").alias("object_name"), "message"),
)
on_events("discover_where", f"SELECT {FLAT_SQL} FROM e WHERE reason = 'BackOff' AND ns = 'ns-3' ORDER BY ts DESC, rv LIMIT 100", lambda e: newest(e.where("reason = 'BackOff' AND metadata.namespace = 'ns-3'"), 100))
on_events("export_ordered", f"SELECT {FLAT_SQL} FROM e ORDER BY ts, rv", lambda e: flat(e.orderBy(TIME, RV)))
on_events("export_where", f"SELECT {FLAT_SQL} FROM e WHERE reason = 'OOMKilling' ORDER BY ts, rv", lambda e: flat(e.where("reason = 'OOMKilling'").orderBy(TIME, RV)))
on_events("cell_predicate", f"SELECT {FLAT_SQL} FROM e WHERE host = 'node-2' AND reason = 'Evicted' AND ns = 'ns-1'", lambda e: flat(e.where(P.cell("source.host", "node-2") & P.critical("Evicted", "ns-1"))))
on_events("namespace_warnings", "SELECT count(*) AS n FROM e WHERE ns = 'ns-2' AND type = 'Warning'", lambda e: e.where(P.namespace_warnings("ns-2")).agg(count_as("n")))
on_events("reason_warnings", "SELECT count(*) AS n FROM e WHERE reason = 'Evicted' AND type = 'Warning'", lambda e: e.where(P.reason_warnings("Evicted")).agg(count_as("n")))
on_events(
    "bar_drilldown",
    "SELECT count(*) AS n FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 06:00:00'",
    lambda e: e.where(P.bar(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), "6 HOURS")).agg(count_as("n")),
)

# --- timelines --------------------------------------------------------------------------------

for _name, _width in (("timeline_10s", "10 seconds"), ("timeline_1m", "1 minutes"), ("timeline_15m", "15 minutes"), ("timeline_3h", "3 hours"), ("timeline_1d", "1 day"), ("timeline_7d", "7 days")):
    on_events(_name, f'SELECT time_bucket(INTERVAL \'{_width}\', ts) AS bucket, type, count(*) AS "count" FROM e GROUP BY 1, 2 ORDER BY 1, 2', lambda e, w=_width: timeline(e, w).orderBy("bucket", "type"))
on_events(
    "timeline_types",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, type, count(*) AS \"count\" FROM e WHERE type IN ('Normal', 'Warning') GROUP BY 1, 2",
    lambda e: timeline(e, "1 hour", F.col("type").isin("Normal", "Warning")),
)
on_events(
    "warning_breakdown_15m",
    "SELECT time_bucket(INTERVAL '15 minutes', ts) AS bucket, reason, count(*) AS \"count\" FROM e WHERE type = 'Warning' GROUP BY 1, 2",
    lambda e: e.where(P.warning()).groupBy(time_bucket(TIME, "15 minutes").alias("bucket"), "reason").agg(count_as("count")).orderBy("bucket", F.desc("count"), "reason"),
)
_WIDE = "w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket, count(*) AS total, count(*) FILTER (WHERE type = 'Warning') AS \"Warning\", count(*) FILTER (WHERE type = 'Normal') AS \"Normal\" FROM e GROUP BY 1)"
on_events("timeline_wide", f", {_WIDE} SELECT * FROM w".lstrip(), lambda e: timeline_wide(e, "6 hours"))
on_events(
    "timeline_pct",
    f', {_WIDE} SELECT bucket, total, "Warning" * 100.0 / ("Warning" + "Normal") AS warning_pct, "Normal" * 100.0 / ("Warning" + "Normal") AS normal_pct FROM w',
    lambda e: timeline_shares(e, "6 hours"),
)

# --- top lists --------------------------------------------------------------------------------


def counted(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias(name)).agg(count_as("count"))


def top(rows: DataFrame, column: str, name: str, n: int) -> DataFrame:
    return counted(rows, column, name).orderBy(F.desc("count"), name).limit(n)


def group_sql(column: str, name: str, where: str = "TRUE", n: int | None = None) -> str:
    limit = f' ORDER BY "count" DESC, {name} LIMIT {n}' if n else ""
    return f'SELECT {column} AS {name}, count(*) AS "count" FROM e WHERE {where} GROUP BY 1{limit}'


on_events("noisy_namespaces", group_sql("ns", "namespace", "ns IS NOT NULL"), lambda e: counted(e.where(F.col(NS).isNotNull()), NS, "namespace").orderBy(F.desc("count"), "namespace"))
on_events("warning_reasons", group_sql("reason", "reason", "type = 'Warning'"), lambda e: counted(e.where(P.warning()), "reason", "reason").orderBy(F.desc("count"), "reason"))
on_events("top_reasons_5", group_sql("reason", "reason", n=5), lambda e: top(e, "reason", "reason", 5))
on_events("by_namespace", group_sql("ns", "namespace"), lambda e: counted(e, NS, "namespace"))
on_events("by_type", group_sql("type", "type"), lambda e: counted(e, "type", "type").orderBy("type"))
on_events("ns_warning_reasons_10", group_sql("reason", "reason", "ns = 'ns-1' AND type = 'Warning'", 10), lambda e: top(e.where((F.col(NS) == "ns-1") & P.warning()), "reason", "reason", 10))
on_events("pods_by_reason", group_sql("pod", "pod", "reason = 'FailedScheduling'", 10), lambda e: top(e.where(F.col("reason") == "FailedScheduling"), "involvedObject.name", "pod", 10))
on_events("top_warning_reasons_10", group_sql("reason", "reason", "type = 'Warning'", 10), lambda e: top(e.where(P.warning()), "reason", "reason", 10))
on_events(
    "noisy_namespace_severity",
    ", c AS (SELECT ns AS namespace, count(*) AS n FROM e GROUP BY 1) SELECT namespace, n AS \"count\", n / max(n) OVER () AS ratio, CASE WHEN n / max(n) OVER () > 0.8 THEN 'error' WHEN n / max(n) OVER () > 0.5 THEN 'warning' ELSE 'info' END AS severity FROM c",
    lambda e: share_of_largest(counted(e, NS, "namespace")),
)
on_events(
    "metric_card_texts",
    "SELECT ns AS namespace, CASE WHEN count(*) >= 1000000 THEN printf('%.1fM', round(count(*) / 1e6, 1)) WHEN count(*) >= 1000 THEN printf('%.1fK', round(count(*) / 1000, 1)) ELSE CAST(count(*) AS VARCHAR) END AS total, printf('%.1f%%', round(count(*) FILTER (WHERE type = 'Warning') * 100.0 / count(*), 1)) AS warnings FROM e GROUP BY 1",
    lambda e: e.groupBy(F.col(NS).alias("namespace")).agg(short_count(F.count("*")).alias("total"), percentage(F.count_if(P.warning()), F.count("*")).alias("warnings")),
)
on_events(
    "reason_severity",
    "SELECT CASE WHEN contains(reason, 'Failed') OR contains(reason, 'Error') THEN 'error' WHEN contains(reason, 'Unhealthy') OR contains(reason, 'Warning') OR contains(reason, 'OutOf') THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM e GROUP BY 1",
    lambda e: e.groupBy(reason_severity().alias("severity")).agg(count_as("n")),
)

# --- an investigation's queries ---------------------------------------------------------------

on_events(
    "agent_latest_reason",
    "SELECT pod AS object, host, reason || ' on ' || pod AS message FROM e WHERE reason = 'SystemOOM' ORDER BY ts DESC, rv LIMIT 1",
    lambda e: e.where("reason = 'SystemOOM'").orderBy(F.desc(TIME), RV).limit(1).select(F.col("involvedObject.name").alias("object"), F.col("source.host").alias("host"), "message"),
)
on_events("agent_mount_host", "SELECT host FROM e WHERE reason = 'FailedMount' ORDER BY ts DESC, rv LIMIT 1", lambda e: e.where("reason = 'FailedMount'").orderBy(F.desc(TIME), RV).limit(1).select(F.col("source.host").alias("host")))
on_events("agent_object_history", f"SELECT {FLAT_SQL} FROM e WHERE pod = 'pod-3' ORDER BY ts, rv", lambda e: flat(e.where(P.cell("involvedObject.name", "pod-3")).orderBy(TIME, RV)))
on_events("agent_node_first10", f"SELECT {FLAT_SQL} FROM e WHERE host = 'node-3' ORDER BY ts, rv LIMIT 10", lambda e: flat(e.where(P.cell("source.host", "node-3"))).orderBy("last_timestamp", "resource_version").limit(10))
on_events("agent_warning_top5", group_sql("reason", "reason", "type = 'Warning'", 5), lambda e: top(e.where(P.warning()), "reason", "reason", 5))
on_events("agent_distinct_like", "SELECT DISTINCT reason FROM e WHERE reason LIKE '%OOM%'", lambda e: e.where(F.col("reason").like("%OOM%")).select("reason").distinct())
on_events("agent_oom_counts", group_sql("reason", "reason", "reason IN ('SystemOOM', 'OOMKilling')"), lambda e: counted(e.where(F.col("reason").isin("SystemOOM", "OOMKilling")), "reason", "reason"))

# --- the store --------------------------------------------------------------------------------

on_events(
    "union_by_name",
    "SELECT rv AS resource_version, CASE WHEN type = 'Warning' THEN reason END AS reason, type FROM e",
    lambda e: e.where(P.warning()).select(F.col(RV).alias("resource_version"), "reason", "type").unionByName(e.where(~P.warning()).select("type", F.col(RV).alias("resource_version")), allowMissingColumns=True),
)
on_events(
    "dedup_first",
    "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) WHERE k = 1",
    lambda e: first_per_key(e.select(F.substring("involvedObject.name", 5, 20).cast("long").alias("user_id"), F.col(RV).cast("long").alias("event_id"), F.col(TIME).alias("ts")), "user_id", "ts", "event_id"),
)


def native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridged events with the schema of the store."""
    return conform(bridged(spark, sf_dir).withColumns({c: F.col(c).cast("timestamp") for c in ("firstTimestamp", TIME)}))


def loaded_store(spark: SparkSession, sf_dir: str, parts: int = 3) -> EventStore:
    """All events as hot segments, each sent twice: the second time nothing is new."""
    store, events = EventStore(spark, new_path(spark, "store")), native(spark, sf_dir)
    for part in range(parts):
        rows = events.where(F.pmod(F.xxhash64(RV), F.lit(parts)) == part)
        for again in (0, 1):
            store.append(rows, "load", 2 * part + again)
    return store


STORED_SQL = f"WITH {BRIDGE_SQL} SELECT {FLAT_SQL} FROM e"


def stored(store: EventStore, start: datetime = START, end: datetime = END) -> DataFrame:
    return flat(store.events(start, end)[0]).withColumn("last_timestamp", F.col("last_timestamp").cast("timestamp_ntz"))


#: A part of the time, which some segments lie outside of.
WINDOW = datetime(2024, 1, 5), datetime(2024, 1, 12)
WINDOW_SQL = f"{STORED_SQL} WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'"


def weekly_store(spark: SparkSession, sf_dir: str, archived: bool = False) -> EventStore:
    """A segment for each week of the month."""
    store, events = EventStore(spark, new_path(spark, "store")), native(spark, sf_dir)
    for week in range(5):
        store.append(events.where(F.floor((F.dayofmonth(TIME) - 1) / 7) == week), "weeks", week)
        if archived:
            archive(store, threshold=0)
    return store


@query("window_hot", WINDOW_SQL)
def window_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(weekly_store(spark, sf_dir), *WINDOW)


@query("window_archived", WINDOW_SQL)
def window_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(weekly_store(spark, sf_dir, archived=True), *WINDOW)


@query("window_compacted", WINDOW_SQL)
def window_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = weekly_store(spark, sf_dir, archived=True)
    compact(store)
    return stored(store, *WINDOW)


@query("window_late_events", WINDOW_SQL)
def window_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace's events come when all others are archived; they lie in the hot part, before the newest archived event."""
    store, events = EventStore(spark, new_path(spark, "store")), native(spark, sf_dir)
    store.append(events.where(f"{NS} <> 'ns-1'"))
    archive(store, threshold=0)
    store.append(events.where(f"{NS} = 'ns-1'"))
    return stored(store, *WINDOW)


@query("window_timeline", f"WITH {BRIDGE_SQL} SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket, type, count(*) AS \"count\" FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1, 2")
def window_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = weekly_store(spark, sf_dir, archived=True).events(*WINDOW)
    return timeline(events, "6 hours").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("archive_bounds", f"WITH {BRIDGE_SQL} SELECT CAST(floor((day(ts) - 1) / 7) AS INTEGER) AS week, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n FROM e GROUP BY 1")
def archive_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of each archived segment."""
    held = [s for s in weekly_store(spark, sf_dir, archived=True).manifest().segments if s.tier == ARCHIVE]
    rows = spark.createDataFrame([(s.min_us, s.max_us, s.rows) for s in held], "low long, high long, n long")
    low, high = (F.timestamp_micros(c).cast("timestamp_ntz") for c in ("low", "high"))
    return rows.select(F.floor((F.dayofmonth(low) - 1) / 7).cast("int").alias("week"), low.alias("min_ts"), high.alias("max_ts"), "n")


@query("archive_row_count", f"WITH {BRIDGE_SQL} SELECT count(*) AS n FROM e")
def archive_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the manifest, and in the files."""
    store = weekly_store(spark, sf_dir, archived=True)
    listed = sum(s.rows for s in store.manifest().segments)
    return store.events(START, END)[0].agg(count_as("n")).where(F.col("n") == listed)


@query("range_inclusive", f"WITH {BRIDGE_SQL}, b AS (SELECT date_trunc('second', min(ts)) AS low, date_trunc('second', max(ts)) AS high FROM e) SELECT count(*) AS n FROM e, b WHERE ts BETWEEN low AND high")
def range_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window from the first event's second to the last one's."""
    store = weekly_store(spark, sf_dir)
    segments = store.manifest().segments
    seconds = [f(us) // 1_000_000 for f, us in ((min, [s.min_us for s in segments]), (max, [s.max_us for s in segments]))]
    return store.events(*[datetime.fromtimestamp(x, timezone.utc) for x in seconds])[0].agg(count_as("n"))


@query("range_empty", f"WITH {BRIDGE_SQL} SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2030-01-01 00:00:00') AS n, count(*) FILTER (WHERE ts > TIMESTAMP '2030-01-01 00:00:00') = 0 AS no_sources, count(*) AS before FROM e")
def range_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window after all events has no segments to read, though the store has some."""
    store, window = weekly_store(spark, sf_dir), (datetime(2030, 1, 1), datetime(2030, 1, 2))
    n, no_sources = F.lit(0).cast("long"), True
    try:
        n, no_sources = F.lit(store.events(*window)[0].count()), False
    except NoDataSources:
        pass
    return stored(store).agg(n.alias("n"), F.lit(no_sources).alias("no_sources"), count_as("before"))


@query("append_dedup", STORED_SQL)
def append_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(loaded_store(spark, sf_dir))


@query("roundtrip_archive", STORED_SQL)
def roundtrip_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = loaded_store(spark, sf_dir)
    archive(store, threshold=0)
    store.vacuum(grace=0)
    return stored(store)


@query("roundtrip_compact", STORED_SQL)
def roundtrip_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, events = EventStore(spark, new_path(spark, "store")), native(spark, sf_dir)
    for part in range(3):
        store.append(events.where(F.pmod(F.xxhash64(RV), F.lit(3)) == part))
        archive(store, threshold=0)
    compact(store)
    store.vacuum(grace=0)
    return stored(store)


# Fixed value: the dashboard's query.
TIMELINE_TEXT = "SELECT time_bucket(INTERVAL '3 hours', lastTimestamp) AS bucket, type, COUNT(*) AS count FROM $events WHERE 1=1 GROUP BY bucket, type ORDER BY bucket, type;"


@query("sql_timeline", f"WITH {BRIDGE_SQL} SELECT time_bucket(INTERVAL '3 hours', ts) AS bucket, type, count(*) AS \"count\" FROM e GROUP BY 1, 2")
def sql_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's SQL text, over the store."""
    from ..engine import Engine

    frame, _ = Engine(spark, loaded_store(spark, sf_dir, 1)).frame(TIMELINE_TEXT, START, END)
    return frame.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    "sql_spellings",
    f"WITH {BRIDGE_SQL} SELECT time_bucket(INTERVAL '1 month', ts) AS bucket, reason, arg_max(rv, struct_pack(a := ts, b := rv)) AS latest, quantile_cont(event_id, 0.5) AS middle, count(*) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND regexp_matches(reason, '^Fail') GROUP BY 1, 2",
)
def sql_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query text with functions and literals in spellings that Spark does not have."""
    from ..engine import Engine

    text = """SELECT time_bucket(INTERVAL '1 month', lastTimestamp) AS bucket, reason, arg_max(metadata.resourceVersion, struct(lastTimestamp, metadata.resourceVersion)) AS latest,
      quantile_cont(CAST(metadata.resourceVersion AS BIGINT), 0.5) AS middle, count(*) AS n
      FROM $events WHERE lastTimestamp >= TIMESTAMPTZ '2024-01-03T00:00:00Z' AND regexp_matches(reason, '^Fail') GROUP BY ALL"""
    frame, _ = Engine(spark, loaded_store(spark, sf_dir, 1)).frame(text, START, END)
    return frame.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("sql_month_bucket", f"WITH {BRIDGE_SQL} SELECT time_bucket(INTERVAL '1 month', ts) AS bucket, count(*) AS n FROM e GROUP BY 1")
def sql_month_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = request_session(spark)
    bridged(session, sf_dir).createOrReplaceTempView("e")
    return session.sql("SELECT CAST(month_bucket(1, CAST(lastTimestamp AS TIMESTAMP)) AS TIMESTAMP_NTZ) AS bucket, count(*) AS n FROM e GROUP BY 1")


#: Rows of a landing file, about.
LANDING_ROWS = 200_000


@query("stream_ingest", STORED_SQL)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a landing folder and the streaming ingest, every file delivered twice; two files at least, and a batch takes as many as are delivered at once."""
    from ..streaming.ingest import ingest, landing

    events = bridged(spark, sf_dir).withColumns({c: F.col(c).cast("timestamp") for c in ("firstTimestamp", TIME)})
    folder, store = new_path(spark, "landing"), EventStore(spark, new_path(spark, "store"))
    parts = max(2, -(-events.count() // LANDING_ROWS))
    for _ in range(2):
        events.repartition(parts, RV).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    running = ingest(landing(spark, folder, parts), store, new_path(spark, "offsets"), once=True)
    running.awaitTermination()
    return stored(store)


@query("stream_rolling_counts", f"WITH {BRIDGE_SQL} SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, type, count(*) AS \"count\" FROM e GROUP BY 1, 2")
def stream_rolling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming roll-up, with a last event far ahead that closes all buckets."""
    from ..streaming.ingest import rolling_counts

    rows = bridged(spark, sf_dir).select(F.col(TIME).cast("timestamp").alias(TIME), "type")
    folder, out = new_path(spark, "rows"), new_path(spark, "counts")
    rows.write.parquet(f"{folder}/1")
    rows.agg(F.lit("2100-01-01").cast("timestamp").alias(TIME), F.lit("end").alias("type")).write.parquet(f"{folder}/2")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/*")
    counts = rolling_counts(stream, "1 hour", "40 days").writeStream.outputMode("append").option("checkpointLocation", new_path(spark, "offsets"))
    counts.format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).where("type <> 'end'").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


# --- what any SQL text may ask for -----------------------------------------------------------

on_tables(
    "join_inner",
    "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
    lambda o, c: o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "o_totalprice"),
    "orders", "customer",
)
on_tables(
    "join_left",
    "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    lambda c, o: c.join(o, o["o_custkey"] == c["c_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")),
    "customer", "orders",
)
on_tables(
    "join_full",
    "SELECT s_suppkey, n_nationkey, s_name, n_name FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey",
    lambda s, n: s.join(n, s["s_nationkey"] == n["n_nationkey"], "full").select("s_suppkey", "n_nationkey", "s_name", "n_name"),
    "supplier", "nation",
)
on_tables("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda c, o: c.join(o, o["o_custkey"] == c["c_custkey"], "left_semi").select("c_custkey"), "customer", "orders")
on_tables(
    "join_anti",
    "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    lambda p, t: p.join(t.where("l_quantity > 49"), t["l_partkey"] == p["p_partkey"], "left_anti").select("p_partkey"),
    "part", "lineitem",
)
on_tables(
    "join_right",
    "SELECT n_name, c_custkey FROM nation RIGHT JOIN customer ON c_nationkey = n_nationkey AND n_regionkey = 1",
    lambda n, c: n.join(c, (c["c_nationkey"] == n["n_nationkey"]) & (n["n_regionkey"] == 1), "right").select("n_name", "c_custkey"),
    "nation", "customer",
)
on_tables("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", lambda r, n: r.crossJoin(n).select("r_name", "n_name"), "region", "nation")
on_tables(
    "join_theta",
    "SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_acctbal > n_nationkey * 300 GROUP BY 1",
    lambda n, s: n.join(s, s["s_acctbal"] > n["n_nationkey"] * 300).groupBy("n_name").agg(count_as("n")),
    "nation", "supplier",
)
on_tables(
    "join_three",
    "SELECT r_name, sum(s_acctbal) AS balance, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    lambda s, n, r: s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.sum("s_acctbal").alias("balance"), count_as("n")),
    "supplier", "nation", "region",
)
on_tables(
    "join_range",
    "SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1 hour' GROUP BY 1",
    lambda e: interval_join(e.select("user_id", "ts", "event_id"), e.select("user_id", "ts"), ["user_id"], "ts", 0, 3600, "right").groupBy("l.event_id").agg(count_as("n")),
    "events",
)
on_tables(
    "join_asof",
    "SELECT p.event_id, coalesce(v.event_id, -1) AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts",
    lambda e: asof_join(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id")), ["user_id"], "ts", F.date_trunc("day", "ts")).select("event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id")),
    "events",
)
on_tables(
    "win_rank",
    "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders QUALIFY r <= 3",
    lambda o: o.select("o_custkey", "o_orderkey", F.rank().over(w := Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))).alias("r"), F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("k")).where("r <= 3"),
    "orders",
)
on_tables(
    "win_lag",
    "SELECT event_id, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    lambda e: e.select("event_id", F.lag("event_id", 1, -1).over(w := Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"), F.lead("event_id", 1, -1).over(w).alias("after")),
    "events",
)
on_tables(
    "win_frame",
    "SELECT event_id, count(*) OVER w AS n, max(event_id) OVER w AS latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
    lambda e: e.select("event_id", F.count("*").over(w := Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 0)).alias("n"), F.max("event_id").over(w).alias("latest")),
    "events",
)
_BY = "l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY"


def sums() -> tuple[Column, Column]:
    return count_as("n"), F.sum("l_linenumber").alias("numbers")


on_tables("rollup", f"SELECT {_BY} ROLLUP (l_returnflag, l_linestatus)", lambda t: t.rollup("l_returnflag", "l_linestatus").agg(*sums()), "lineitem")
on_tables("cube", f"SELECT {_BY} CUBE (l_returnflag, l_linestatus)", lambda t: t.cube("l_returnflag", "l_linestatus").agg(*sums()), "lineitem")
on_tables(
    "grouping_sets",
    f"SELECT {_BY} GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    lambda t: t.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(*sums()),
    "lineitem",
)
on_tables(
    "pivot",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1",
    lambda o: o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count().na.fill(0).select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o")),
    "orders",
)
_CUSTOMERS = lambda c, o: (c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")))
on_tables("intersect", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders", lambda c, o: (x := _CUSTOMERS(c, o))[0].intersect(x[1]), "customer", "orders")
on_tables("except", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49", lambda p, t: p.select("p_partkey").subtract(t.where("l_quantity > 49").select("l_partkey")), "part", "lineitem")
on_tables("approx_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, abs(approx_count_distinct(l_partkey) / count(DISTINCT l_partkey) - 1) < 0.2 AS near FROM lineitem GROUP BY 1", lambda t: t.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), (F.abs(F.approx_count_distinct("l_partkey", 0.02) / F.countDistinct("l_partkey") - 1) < 0.1).alias("near")), "lineitem")
on_tables("mode_list", "SELECT l_linestatus, mode(l_returnflag) AS usual, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1", lambda t: t.groupBy("l_linestatus").agg(F.mode("l_returnflag").alias("usual"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags")), "lineitem")


@query("group_by_all", "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_shipdate) AS latest FROM lineitem GROUP BY ALL")
def group_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = request_session(spark)
    session.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return session.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_shipdate) AS latest FROM lineitem GROUP BY ALL")


on_tables("union_distinct", "SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders", lambda c, o: (x := _CUSTOMERS(c, o))[0].union(x[1]).distinct(), "customer", "orders")
on_tables("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1", lambda t: t.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers")), "lineitem")
on_tables("percentile", "SELECT event_type, quantile_cont(value, 0.9) AS p90, median(value) AS p50 FROM events GROUP BY 1", lambda e: e.groupBy("event_type").agg(F.percentile("value", 0.9).alias("p90"), F.median("value").alias("p50")), "events")
on_tables("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10", lambda o: o.groupBy("o_custkey").agg(count_as("n")).where("n > 10"), "orders")
on_tables("filter_aggregate", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1", lambda e: e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks")), "events")
on_tables("arg_max", "SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS latest FROM events GROUP BY 1", lambda e: e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest")), "events")
on_tables(
    "string_agg",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    lambda n: n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names")),
    "nation",
)
on_tables(
    "string_functions",
    "SELECT c_custkey, upper(c_name) AS up, length(c_name) AS n, substr(c_name, 1, 4) AS head, replace(c_name, '#', '-') AS dashed, split_part(c_name, '#', 2) AS tail, strpos(c_name, '#') AS place, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_matches(c_name, '[13579]$') AS odd, starts_with(c_name, 'C') AS c, concat_ws('/', c_name, c_mktsegment) AS both FROM customer",
    lambda c: c.select("c_custkey", F.upper("c_name").alias("up"), F.length("c_name").cast("long").alias("n"), F.substring("c_name", 1, 4).alias("head"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("dashed"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"), F.instr("c_name", "#").cast("long").alias("place"), F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits"), F.col("c_name").rlike("[13579]$").alias("odd"), F.col("c_name").startswith("C").alias("c"), F.concat_ws("/", "c_name", "c_mktsegment").alias("both")),
    "customer",
)
on_tables(
    "more_string_functions",
    "SELECT c_custkey, lower(c_name) AS low, trim('  ' || c_mktsegment || ' ') AS bare, ltrim('xx' || c_mktsegment, 'x') AS cut, contains(c_name, '01') AS has, lpad(c_mktsegment, 12, '*') AS padded, reverse(c_mktsegment) AS turned, left(c_name, 3) AS head, right(c_name, 3) AS tail, repeat(left(c_name, 1), 3) AS thrice, ascii(c_name) AS code FROM customer",
    lambda c: c.select("c_custkey", F.lower("c_name").alias("low"), F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("bare"), F.ltrim(F.concat(F.lit("xx"), "c_mktsegment"), F.lit("x")).alias("cut"), F.contains("c_name", F.lit("01")).alias("has"), F.lpad("c_mktsegment", 12, "*").alias("padded"), F.reverse("c_mktsegment").alias("turned"), F.left("c_name", F.lit(3)).alias("head"), F.right("c_name", F.lit(3)).alias("tail"), F.repeat(F.left("c_name", F.lit(1)), 3).alias("thrice"), F.ascii("c_name").alias("code")),
    "customer",
)
on_tables(
    "more_date_functions",
    "SELECT o_orderkey, CAST(date_part('quarter', o_orderdate) AS INTEGER) AS quarter, CAST(date_part('doy', o_orderdate) AS INTEGER) AS doy, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS days, last_day(o_orderdate) AS month_end, CAST(extract(week FROM o_orderdate) AS INTEGER) AS week, CAST(o_orderdate AS DATE) AS d FROM orders",
    lambda o: o.select("o_orderkey", F.date_part(F.lit("quarter"), "o_orderdate").alias("quarter"), F.date_part(F.lit("doy"), "o_orderdate").alias("doy"), F.datediff(F.lit("2000-01-01").cast("date"), "o_orderdate").cast("long").alias("days"), F.last_day("o_orderdate").alias("month_end"), F.weekofyear("o_orderdate").alias("week"), F.to_date("o_orderdate").alias("d")),
    "orders",
)
on_tables(
    "more_math_functions",
    "SELECT s_suppkey, abs(s_acctbal) AS size, power(s_nationkey, 2) AS square, CAST(ceil(s_acctbal) AS BIGINT) AS up, CAST(sign(s_acctbal) AS INTEGER) AS way, exp(s_nationkey / 10.0) AS grown, log10(s_nationkey + 1) AS digits, s_nationkey & 7 AS low_bits, trunc(s_acctbal) AS whole FROM supplier",
    lambda s: s.select("s_suppkey", F.abs("s_acctbal").alias("size"), F.pow("s_nationkey", F.lit(2)).alias("square"), F.ceil("s_acctbal").alias("up"), F.signum("s_acctbal").cast("int").alias("way"), F.exp(F.col("s_nationkey") / 10.0).alias("grown"), F.log10(F.col("s_nationkey") + 1).alias("digits"), F.col("s_nationkey").bitwiseAND(7).alias("low_bits"), (F.signum("s_acctbal") * F.floor(F.abs("s_acctbal"))).alias("whole")),
    "supplier",
)
on_tables(
    "date_functions",
    "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, epoch_ms(o_orderdate) AS millis, strftime(o_orderdate, '%Y-%m') AS label, o_orderdate + INTERVAL 90 DAY AS due FROM orders",
    lambda o: o.select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), F.year("o_orderdate").alias("y"), (F.dayofweek("o_orderdate") - 1).alias("weekday"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("seconds"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("millis"), F.date_format("o_orderdate", "yyyy-MM").alias("label"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("due")),
    "orders",
)
on_tables(
    "math_functions",
    "SELECT p_partkey, p_size // 7 AS sevens, p_size % 7 AS rest, sqrt(p_size) AS root, ln(p_size) AS log, greatest(p_size, 10) AS big, p_retailprice / nullif(p_size, 0) AS each, round(p_retailprice / 3, 2) AS third, floor(p_retailprice) AS low FROM part",
    lambda p: p.select("p_partkey", F.expr("CAST(p_size div 7 AS INT)").alias("sevens"), (F.col("p_size") % 7).alias("rest"), F.sqrt("p_size").alias("root"), F.ln("p_size").alias("log"), F.greatest("p_size", F.lit(10)).alias("big"), (F.col("p_retailprice") / F.nullif("p_size", F.lit(0))).alias("each"), F.round(F.col("p_retailprice") / 3, 2).alias("third"), F.floor("p_retailprice").cast("double").alias("low")),
    "part",
)
on_tables(
    "array_functions",
    "SELECT user_id, len(list(event_type)) AS n, list_contains(list(event_type), 'error') AS errs, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1",
    lambda e: e.groupBy("user_id").agg(F.collect_list("event_type").alias("types")).select("user_id", F.size("types").cast("long").alias("n"), F.array_contains("types", "error").alias("errs"), F.array_join(F.array_sort(F.array_distinct("types")), ",").alias("kinds")),
    "events",
)
on_tables(
    "unnest_words",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1",
    lambda p: p.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(count_as("n")),
    "part",
)
on_tables(
    "json_functions",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, array_to_string(json_keys(props), ',') AS keys FROM events",
    lambda e: e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("keys")),
    "events",
)
on_tables(
    "subquery_cte",
    "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT o_custkey FROM big WHERE total > (SELECT avg(total) FROM big)",
    lambda o: (big := o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))).join(big.agg(F.avg("total").alias("mean")), F.col("total") > F.col("mean")).select("o_custkey"),
    "orders",
)
on_tables(
    "session_windows",
    "SELECT user_id, min(ts) AS began, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '2 hours' > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session",
    lambda e: e.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.min("ts").alias("began"), count_as("n")).drop("s"),
    "events",
)
on_tables(
    "predicates_misc",
    "SELECT c_custkey FROM customer WHERE (c_mktsegment ILIKE 'auto%' OR NOT (c_acctbal BETWEEN 0 AND 5000)) AND c_name LIKE '%1_' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)",
    lambda c, n: c.where((F.col("c_mktsegment").ilike("auto%") | ~F.col("c_acctbal").between(0, 5000)) & F.col("c_name").like("%1_")).join(n.where("n_regionkey <> 2"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey"),
    "customer", "nation",
)
on_tables(
    "conditional_functions",
    "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind, ifnull(nullif(user_id, 3), -1) AS u, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS level, least(value, 20) AS capped FROM events",
    lambda e: e.select("event_id", F.coalesce(F.nullif("event_type", F.lit("click")), F.lit("none")).alias("kind"), F.ifnull(F.nullif("user_id", F.lit(3)), F.lit(-1)).alias("u"), F.when(F.col("value") > 50, "high").when(F.col("value") > 10, "mid").otherwise("low").alias("level"), F.least("value", F.lit(20.0)).alias("capped")),
    "events",
)
on_tables(
    "lambda_functions",
    "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x)), '+') AS loud, len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4)) AS n_long, string_split(p_name, ' ')[1] AS first FROM part",
    lambda p: p.withColumn("w", F.split("p_name", " ")).select("p_partkey", F.array_join(F.transform("w", F.upper), "+").alias("loud"), F.size(F.filter("w", lambda x: F.length(x) > 4)).cast("long").alias("n_long"), F.element_at("w", 1).alias("first")),
    "part",
)
on_tables(
    "map_struct_functions",
    "SELECT event_id, struct_extract(struct_pack(kind := event_type, who := user_id), 'kind') AS kind, array_to_string(map_keys(map([event_type], [user_id])), ',') AS keys, map_values(map([event_type], [user_id]))[1] AS who FROM events",
    lambda e: e.select("event_id", F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("who"))["kind"].alias("kind"), F.array_join(F.map_keys(F.create_map("event_type", "user_id")), ",").alias("keys"), F.element_at(F.map_values(F.create_map("event_type", "user_id")), 1).alias("who")),
    "events",
)
on_tables(
    "aggregate_functions",
    "SELECT event_type, bool_or(user_id = 3) AS any3, bool_and(value >= 0) AS positive, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS earliest, min(value) AS low, max(value) AS high, count(value) AS n, round(stddev_samp(value), 6) AS spread FROM events GROUP BY 1",
    lambda e: e.groupBy("event_type").agg(F.bool_or(F.col("user_id") == 3).alias("any3"), F.bool_and(F.col("value") >= 0).alias("positive"), F.min_by("event_id", F.struct("ts", "event_id")).alias("earliest"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"), F.round(F.stddev_samp("value"), 6).alias("spread")),
    "events",
)
on_tables(
    "win_cumulative",
    "SELECT event_id, ntile(4) OVER w AS quarter, dense_rank() OVER w AS place, first_value(event_id) OVER w AS first, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    lambda e: e.select("event_id", F.ntile(4).over(w := Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("quarter"), F.dense_rank().over(w).alias("place"), F.first("event_id").over(w).alias("first"), F.row_number().over(w).alias("k")),
    "events",
)
on_tables(
    "sliding_windows",
    "SELECT event_type, w AS began, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w FROM events) GROUP BY 1, 2",
    lambda e: e.groupBy("event_type", F.window("ts", "2 hours", "1 hour").alias("w")).agg(count_as("n")).select("event_type", F.col("w.start").alias("began"), "n"),
    "events",
)

# --- sources and sinks ------------------------------------------------------------------------

_FORMATS = {
    "csv": {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "orc": {"compression": "zstd"},
    "parquet": {"compression": "zstd"},
}


def _roundtrip(kind: str, options: dict[str, str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, path = flat(bridged(spark, sf_dir)), new_path(spark, kind)
        rows.write.format(kind).options(**options).save(path)
        return spark.read.format(kind).options(**options).schema(rows.schema).load(path)

    return run


for _kind, _options in _FORMATS.items():
    query(f"roundtrip_{_kind}", STORED_SQL)(_roundtrip(_kind, _options))


@query("export_jsonl_gzip", STORED_SQL)
def export_jsonl_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's export as gzipped JSON lines, read again."""
    from ..engine import Engine
    from ..sources.schema import EVENT_SCHEMA

    path = new_path(spark, "export")
    Engine(spark, loaded_store(spark, sf_dir, 1)).export_files(path, START, END)
    return flat(spark.read.schema(EVENT_SCHEMA).json(path)).withColumn("last_timestamp", F.col("last_timestamp").cast("timestamp_ntz"))

"""The flat table ``events`` seen as native events, in both engines' words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The reason for each remainder of the property k by 16.
REASONS = ("FailedScheduling", "Evicted", "FailedCreatePodSandBox", "BackOff", "NodeNotReady", "NodeHasDiskPressure", "Unhealthy", "FailedMount", "InvalidDiskCapacity", "FailedToCreateEndpoint", "SystemOOM", "OOMKilling", "Scheduled", "Pulled", "Started", "Killing")
WARNINGS = 12


def bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested events; times stay without zone, as in the table."""
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (k % 16) + 1)
    kind = F.when(k % 16 < WARNINGS, "Warning").otherwise("Normal")
    version = F.col("event_id").cast("string")
    namespace = F.concat(F.lit("ns-"), (F.col("user_id") % 7).cast("string"))
    name = F.concat(F.lit("pod-"), F.col("user_id").cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit("Event").alias("kind"),
        F.lit("v1").alias("apiVersion"),
        F.struct(F.concat(F.lit("event-"), version).alias("name"), namespace.alias("namespace"), version.alias("uid"), version.alias("resourceVersion"), F.col("ts").alias("creationTimestamp")).alias("metadata"),
        F.struct(F.lit("Pod").alias("kind"), namespace.alias("namespace"), name.alias("name")).alias("involvedObject"),
        reason.alias("reason"),
        F.concat(reason, F.lit(" on "), name).alias("message"),
        F.struct(F.col("event_type").alias("component"), F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("host")).alias("source"),
        F.col("ts").alias("firstTimestamp"),
        F.col("ts").alias("lastTimestamp"),
        F.lit(1).alias("count"),
        kind.alias("type"),
    )


def _sql() -> str:
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER) % 16"
    reasons = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS))
    return (
        f"e AS (SELECT CAST(event_id AS VARCHAR) AS rv, 'ns-' || CAST(user_id % 7 AS VARCHAR) AS ns, 'pod-' || CAST(user_id AS VARCHAR) AS pod, "
        f"event_type AS component, 'node-' || CAST(user_id % 5 AS VARCHAR) AS host, CASE {k} {reasons} END AS reason, "
        f"CASE WHEN {k} < {WARNINGS} THEN 'Warning' ELSE 'Normal' END AS type, ts, event_id, user_id FROM events)"
    )


#: A common table expression ``e`` with the bridged events, flat.
BRIDGE_SQL = _sql()

"""Predicates that the dashboard builds from clicks, as columns: no value is ever put into SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_FIELDS = ("type", "reason", "involvedObject.kind", "involvedObject.namespace", "involvedObject.name", "metadata.namespace", "source.component", "source.host")

# The reasons that the metric cards count.
FAILED_PODS = ("FailedScheduling", "Evicted", "FailedCreatePodSandBox")
NODE_ISSUES = ("NodeNotReady", "NodeHasDiskPressure", "Unhealthy", "TaintManagerEviction", "NodeNotSchedulable", "ImageGCFailed", "FreeDiskSpaceFailed", "FailedSync")
NETWORK = ("FailedToCreateEndpoint", "FailedToUpdateEndpoint", "ErrUpdateFailed")
STORAGE = ("FailedMount", "VolumeFailedDelete", "InvalidDiskCapacity")


def cell(field: str, value: str) -> Column:
    """A field of the event detail equals a value; an empty namespace stands for ``default``."""
    if field not in CELL_FIELDS:
        raise ValueError(f"no such field: {field}")
    return F.col(field) == F.lit("default" if field.endswith("namespace") and not value else value)


def warning() -> Column:
    return F.col("type") == "Warning"


def namespace_warnings(namespace: str) -> Column:
    return cell("metadata.namespace", namespace) & warning()


def reason_warnings(reason: str) -> Column:
    return cell("reason", reason) & warning()


def critical(reason: str, namespace: str) -> Column:
    return cell("reason", reason) & cell("metadata.namespace", namespace)


def metric_card(name: str) -> Column:
    """The rows behind a metric card."""
    cards = {
        "total": F.lit(True),
        "warnings": warning(),
        "failed_pods": F.col("reason").isin(*FAILED_PODS),
        "restarts": F.col("reason") == "BackOff",
        "node_issues": warning() & F.col("reason").isin(*NODE_ISSUES),
        "network": warning() & F.col("reason").isin(*NETWORK),
        "storage": warning() & F.col("reason").isin(*STORAGE),
    }
    return cards[name]


def bar(bucket: Column, width: str, time: str = "lastTimestamp") -> Column:
    """The window of a chart bar, both ends included."""
    return F.col(time).between(bucket, bucket + F.expr(f"INTERVAL {width}"))

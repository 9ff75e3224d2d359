"""What the driver and the executors use: memory, as Spark's own status has it, and the files in their local folders."""

from __future__ import annotations

import os
import socket
import time
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

#: Tasks for each slot that look at the local folders, and how long each waits, so that every executor gets some.
TASKS, WAIT = 3, 0.1
FOUND = "folder string, host string, files long, bytes long, free long"


def _usage(folder: str) -> tuple[int, int]:
    """Number and bytes of the files below."""
    count = size = 0
    for at, _, names in os.walk(folder):
        for name in names:
            try:
                size += os.path.getsize(os.path.join(at, name))
                count += 1
            except OSError:  # it has gone meanwhile
                pass
    return count, size


def local_folders(spark: SparkSession) -> list[dict[str, Any]]:
    """Files and bytes of each local folder of the executors, and the room left beside them, found by tasks that run there.

    An executor that is busy with other work all the time gives no row.
    """
    slots = spark.sparkContext.defaultParallelism

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        time.sleep(WAIT)
        rows = []
        for folder in filter(None, os.environ.get("SPARK_LOCAL_DIRS", "").split(",")):
            if os.path.isdir(folder):
                disk = os.statvfs(folder)
                rows.append((folder, socket.gethostname(), *_usage(folder), disk.f_bavail * disk.f_frsize))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["folder", "host", "files", "bytes", "free"])

    found = spark.range(0, slots * TASKS, 1, slots * TASKS).mapInArrow(look, FOUND).distinct().collect()  # a few rows an executor
    newest = {(r["host"], r["folder"]): r.asDict() for r in found}
    return [newest[k] for k in sorted(newest)]


def executors(spark: SparkSession) -> list[dict[str, Any]]:
    """Driver and executors by Spark's status: memory for storage, heap in use at its peak, bytes of blocks on disk, tasks, and time in garbage collection."""
    listed = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    out = []
    for k in range(listed.size()):
        x = listed.apply(k)
        peak = x.peakMemoryMetrics()
        heap = peak.get().getMetricValue("JVMHeapMemory") if peak.isDefined() else 0
        out.append({"id": x.id(), "host": x.hostPort(), "most": x.maxMemory(), "used": x.memoryUsed(), "free": x.maxMemory() - x.memoryUsed(), "peak_heap": heap, "disk": x.diskUsed(), "cores": x.totalCores(), "active_tasks": x.activeTasks(), "failed_tasks": x.failedTasks(), "gc_ms": x.totalGCTime()})
    return sorted(out, key=lambda x: x["id"])

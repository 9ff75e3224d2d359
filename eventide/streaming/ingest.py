"""Continuous ingest: a JSON landing folder into the event store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.time_bucket import width_seconds
from ..sources.schema import EVENT_SCHEMA, normalise
from ..sources.store import EventStore


class CollectedCounter(StreamingQueryListener):
    """events_collected_total: rows that have come in, before any is dropped as known."""

    def __init__(self) -> None:
        self.total = 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.total += event.progress.numInputRows

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def exposition(self) -> str:
        return f"# HELP events_collected_total Events that have come in.\n# TYPE events_collected_total counter\nevents_collected_total {self.total}\n"


def landing(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON files of a folder as a stream; the number of files of a batch is the back-pressure."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(stream: DataFrame, store: EventStore, checkpoint: str, name: str = "ingest", once: bool = False) -> StreamingQuery:
    """Normalise and append the stream's events, every five seconds, or once over all that is there.

    There is no watermark: an event may come as late as it likes.
    """
    writer = normalise(stream).writeStream.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda rows, batch: store.append(rows, name, batch) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def rolling_counts(stream: DataFrame, width: str, late: str, time: str = "lastTimestamp") -> DataFrame:
    """A streaming roll-up by bucket and type; a bucket is final when the watermark has passed it."""
    seconds = f"{width_seconds(width)} seconds"
    counted = stream.withWatermark(time, late).groupBy(F.window(time, seconds), "type").agg(F.count("*").alias("count"))
    return counted.select(F.col("window.start").alias("bucket"), "type", "count")

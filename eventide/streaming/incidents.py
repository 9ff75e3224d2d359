"""Incidents: the events of a key that follow each other without a long silence, closed when the silence is certain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INCIDENT = "key string, first timestamp, last timestamp, n long"
Span = tuple[int, int, int]


#: Keys share so many states, by their hash: a call to Python, and one to the state store, is then for many keys.
BUCKETS = 4096
OPEN = ["key", "first", "last", "n"]


def merged_rows(spans: pd.DataFrame, gap: int) -> pd.DataFrame:
    """First, last and number of events of each incident of each key, from those of shorter ones in any order. A silence of gap or longer parts two."""
    spans = spans.sort_values(["key", "first"], ignore_index=True)
    if not len(spans):
        return spans
    key, first = spans["key"].to_numpy(), spans["first"].to_numpy()
    until = spans.groupby("key", sort=False)["last"].cummax().to_numpy() + gap
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (first[1:] >= until[:-1])])
    return spans.groupby(fresh.cumsum(), sort=False).agg({"key": "first", "first": "min", "last": "max", "n": "sum"}).reset_index(drop=True)


def merged(spans: list[Span], gap: int) -> list[Span]:
    """The same for one key."""
    rows = merged_rows(pd.DataFrame([("", *s) for s in spans], columns=OPEN), gap)
    return [tuple(map(int, s)) for s in rows[OPEN[1:]].itertuples(index=False)]


class Incidents(StatefulProcessor):
    """The state of a bucket holds its keys' open incidents, of which a key has more than one only while events may still come between them."""

    def __init__(self, gap_micros: int) -> None:
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "key string, first long, last long, n long")

    def held(self) -> pd.DataFrame:
        rows = list(self.open.get()) if self.open.exists() else []
        return pd.DataFrame(rows, columns=OPEN).astype(dict.fromkeys(OPEN[1:], "int64"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        for part in rows:
            came = pd.DataFrame({"key": part["key"], "first": part["at"], "last": part["at"], "n": 1})
            held = merged_rows(pd.concat([held, came]) if len(held) else came, self.gap)
        yield from self.settle(held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(self.held(), timerValues.getCurrentWatermarkInMs())

    def settle(self, held: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        """Give out what no event can prolong any more, keep the rest, and set a timer for the next to close."""
        over = held["last"] + self.gap <= watermark * 1000
        closed, left = held[over], held[~over]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(left):
            self.open.put(list(zip(*[left[c].tolist() for c in OPEN], strict=True)))
            self.handle.registerTimer(-(-(int(left["last"].min()) + self.gap) // 1000))
        else:
            self.open.clear()
        if len(closed):
            times = {c: pd.to_datetime(closed[c], unit="us") for c in ("first", "last")}
            yield closed.assign(**times)

    def close(self) -> None: ...


def incidents(events: DataFrame, key: str, time: str, gap_seconds: int, late: str) -> DataFrame:
    """A row for each incident of a key, once the watermark says that it is over: key, first, last, n. Events may come ``late``.

    The session needs ``STATE_STORE`` as its state store provider: see ``with_state``. Events without key or time are left out.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("at"))
    grouped = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).withWatermark("time", late).groupBy("bucket")
    return grouped.transformWithStateInPandas(Incidents(gap_seconds * 1_000_000), T.StructType.fromDDL(INCIDENT), "Append", "EventTime")


def with_state(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams may keep keyed state with timers."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session

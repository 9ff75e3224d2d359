"""The event store: immutable Parquet segments and a manifest that says which of them count.

New micro-batches are hot segments; archiving and compaction replace segments by larger, sorted ones. A
manifest version is one small file, published whole: readers see a change at once or not at all, and a
segment that no manifest lists is never read. Segments carry the true bounds of their times, so a window
reads only those it overlaps; Parquet statistics prune within them.

Writers may run side by side. A version is only published if it is still the next one; else the writer looks again at what
the manifest lists now: an append looks its keys up anew, a merge whose segments have gone gives up. ``vacuum`` deletes files
only after a time of grace, in which readers and writers that know an older manifest come to their end.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import first_per_key, new_keys
from . import files
from .keys import FILTER, key_filter, segments_with, slots_for
from .log import Folder, SharedFolder, VersionLog
from .schema import EVENT_SCHEMA, KEY, TIME, conform
from .sketches import sketched

HOT, ARCHIVE = "hot", "archive"


class NoDataSources(Exception):
    """The window overlaps no segment."""


@dataclass(frozen=True)
class Segment:
    """min_us and max_us bound the last times, in microseconds; None: unknown, so always read.

    low_key and high_key bound the keys, by length and then by text; slots is the size of their filter (0: no row has a key; None: there
    is no filter, so appends read the segment).
    """

    id: str
    tier: str
    rows: int
    bytes: int
    min_us: int | None
    max_us: int | None
    low_key: str | None = None
    high_key: str | None = None
    slots: int | None = None
    #: whether sketches lie beside it
    sketched: bool = False

    def may_hold(self, low: str, high: str) -> bool:
        """Whether keys between these may be in the segment, by the bounds alone."""
        if self.slots is None or self.low_key is None or self.high_key is None:
            return self.slots != 0
        place = lambda key: (len(key), key.encode())
        return place(self.low_key) <= place(high) and place(self.high_key) >= place(low)

    def overlaps(self, start_us: int, end_us: int) -> bool:
        return self.min_us is None or self.max_us is None or (self.max_us >= start_us and self.min_us <= end_us)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: tuple[Segment, ...] = ()
    #: the last micro-batch of each stream that is in
    batches: dict[str, int] = field(default_factory=dict)
    #: segments that were replaced, and when, in seconds
    dropped: dict[str, float] = field(default_factory=dict)
    #: the tokens of the versions that led here
    lineage: tuple[str, ...] = ()

    def to_record(self) -> dict:
        return {"version": self.version, "lineage": list(self.lineage), "segments": [asdict(s) for s in self.segments], "batches": self.batches, "dropped": self.dropped}

    @staticmethod
    def from_record(raw: dict) -> Manifest:
        return Manifest(raw["version"], tuple(Segment(**s) for s in raw["segments"]), raw["batches"], raw.get("dropped", {}), tuple(raw.get("lineage", ())))


def micros(t: datetime) -> int:
    """Whole seconds, as the window's ends are given in them; a time without zone is UTC."""
    aware = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return int(aware.timestamp() // 1) * 1_000_000


def instant(us: int) -> F.Column:
    return F.timestamp_micros(F.lit(us))


#: Seconds for which a file that is no longer listed, or not yet, is kept: longer than any query or write takes.
GRACE = 3600.0


class EventStore:
    """Any number of readers and writers, of any processes.

    log: where the manifest's versions are kept, if not in a folder of the store (for stores that need a service to create a file only once).
    """

    def __init__(self, spark: SparkSession, root: str, log: Folder | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = VersionLog(log or SharedFolder(spark, f"{self.root}/manifest"))

    def versions(self) -> list[str]:
        return self.log.names()

    def manifest(self) -> Manifest:
        newest = self.log.newest()
        return Manifest.from_record(newest) if newest else Manifest()

    def publish(self, before: Manifest, **changes) -> bool:
        """Publish the manifest with these changes, unless another version has come meanwhile."""
        return self.log.follow(before.to_record() if before.version else None, replace(before, **changes).to_record())

    def path(self, segment_id: str) -> str:
        return f"{self.root}/segments/{segment_id}"

    def filter_path(self, segment_id: str) -> str:
        return f"{self.root}/filters/{segment_id}"

    def sketch_path(self, segment_id: str) -> str:
        return f"{self.root}/sketches/{segment_id}"

    def delete_segment(self, segment_id: str) -> None:
        for path in (self.path(segment_id), self.filter_path(segment_id), self.sketch_path(segment_id)):
            files.delete_dir(path)

    def rows_of(self, *segment_ids: str) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).parquet(*[self.path(i) for i in segment_ids])

    def keys_of(self, *segment_ids: str) -> DataFrame:
        return self.rows_of(*segment_ids).select(F.col(KEY).alias("key"))

    def write_segment(self, rows: DataFrame, tier: str) -> Segment | None:
        """Write rows as a segment that no manifest lists yet, with the filter of its keys; None if there are no rows.

        Counts and bounds are taken while the rows are written; only the keys are read again, and what archived segments have sketches of.
        """
        segment_id, seen, key = uuid.uuid4().hex, Observation(), F.col(KEY)
        placed = F.when(key.isNotNull(), F.struct(F.length(key), key))
        figures = [F.count(F.lit(1)).alias("n"), F.count(key).alias("keys"), F.count(TIME).alias("timed"), F.unix_micros(F.min(TIME)).alias("low"), F.unix_micros(F.max(TIME)).alias("high"), F.min(placed).alias("low_key"), F.max(placed).alias("high_key")]
        rows.observe(seen, *figures).write.option("compression", "zstd").parquet(self.path(segment_id))
        found = seen.get
        if not found["n"]:
            self.delete_segment(segment_id)
            return None
        slots = slots_for(found["keys"])
        if slots:
            key_filter(self.keys_of(segment_id), segment_id, slots).write.parquet(self.filter_path(segment_id))
        if tier == ARCHIVE:
            sketched(self.rows_of(segment_id)).write.option("compression", "zstd").parquet(self.sketch_path(segment_id))
        times = (found["low"], found["high"]) if found["timed"] == found["n"] else (None, None)
        ends = [found[c][1] if found[c] else None for c in ("low_key", "high_key")]
        return Segment(segment_id, tier, found["n"], sum(size for _, size in files.parts_in(self.path(segment_id))), *times, *ends, slots, tier == ARCHIVE)

    def append(self, events: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Add the events whose key is new; the first of a key wins. Gives the number of rows that are added.

        A stream's batch that is in already is skipped, so a repeated batch changes nothing. The batch is written once,
        and once more only if the store holds some of its keys.
        """
        now = self.manifest()
        known = lambda: stream is not None and batch is not None and now.batches.get(stream, -1) >= batch
        if known():
            return 0
        added, checked = self.write_segment(first_per_key(conform(events), KEY), HOT), set()
        now = self.manifest()
        while True:
            if known():
                if added:
                    self.delete_segment(added.id)
                return 0
            if added:
                added = self.without_known(added, [s for s in now.segments if s.id not in checked])
                checked |= {s.id for s in now.segments}
            batches = now.batches if stream is None or batch is None else now.batches | {stream: batch}
            if not added and batches == now.batches:
                return 0
            if self.publish(now, segments=(*now.segments, *([added] if added else [])), batches=batches):
                return added.rows if added else 0
            now = self.manifest()  # another version came first: look the keys up in what it has brought

    def without_known(self, added: Segment, held: list[Segment]) -> Segment | None:
        """The segment, or another without the rows whose keys these segments hold; None if no row is left."""
        near = self.holders(added, held)
        if not near:
            return added
        rows = new_keys(self.rows_of(added.id), self.keys_of(*near), KEY, "key")
        fewer = self.write_segment(rows, added.tier)
        if fewer and fewer.rows == added.rows:
            self.delete_segment(fewer.id)
            return added
        self.delete_segment(added.id)
        return fewer

    def holders(self, added: Segment, held: list[Segment]) -> list[str]:
        """The segments that may hold a key of this one, by the bounds of their keys and their filters."""
        if not added.slots or added.low_key is None or added.high_key is None:
            return [] if added.slots == 0 else [s.id for s in held]
        near = [s for s in held if s.may_hold(added.low_key, added.high_key)]
        asked = [s for s in near if s.slots]
        found = set()
        if asked:
            filters = self.spark.read.schema(FILTER).parquet(*[self.filter_path(s.id) for s in asked])
            found = set(segments_with(self.keys_of(added.id), filters, sorted({s.slots for s in asked})))
        return [s.id for s in near if s.slots is None or s.id in found]

    def relevant(self, start: datetime, end: datetime) -> list[Segment]:
        return [s for s in self.manifest().segments if s.overlaps(micros(start), micros(end))]

    def events(self, start: datetime, end: datetime, spark: SparkSession | None = None, elide_hot: bool = False) -> tuple[DataFrame, list[Segment]]:
        """The events of a window, both ends included, and the segments that are read.

        elide_hot leaves the hot segments out if the window ends before the newest archived event, which
        loses late events; it is only there to compare.
        """
        chosen = self.relevant(start, end)
        if elide_hot:
            newest = max((s.max_us for s in self.manifest().segments if s.tier == ARCHIVE and s.max_us is not None), default=None)
            if newest is not None and micros(end) < newest:
                chosen = [s for s in chosen if s.tier != HOT]
        if not chosen:
            raise NoDataSources("no data lies in the query's time range")
        held = (spark or self.spark).read.schema(EVENT_SCHEMA).parquet(*[self.path(s.id) for s in chosen])
        return held.where(F.col(TIME).between(instant(micros(start)), instant(micros(end)))), chosen

    def replace_segments(self, old: list[Segment], new: Segment | None) -> bool:
        """Publish the exchange; the old files stay until ``vacuum``. False, and nothing is changed, if one of the old is no longer listed."""
        gone = {s.id for s in old}
        while True:
            now = self.manifest()
            kept = [s for s in now.segments if s.id not in gone]
            if len(kept) + len(gone) != len(now.segments):
                return False
            if self.publish(now, segments=(*kept, *([replace(new, tier=ARCHIVE)] if new else [])), dropped=now.dropped | dict.fromkeys(gone, time.time())):
                return True

    def vacuum(self, grace: float = GRACE) -> int:
        """Delete replaced segments, segments that were never listed, and old manifest versions, each after so many seconds.

        Gives the number of segments deleted.
        """
        before, now = time.time() - grace, self.manifest()
        listed = {s.id for s in now.segments}
        old = [i for i, at in now.dropped.items() if at <= before]
        for name in files.names_in(f"{self.root}/segments"):
            if name not in listed and name not in now.dropped and (files.newest_change(self.path(name)) or before) < before:
                old.append(name)
        for name in old:
            self.delete_segment(name)
        self.log.prune(before)
        while set(old) & set(now.dropped) and not self.publish(now, dropped={i: at for i, at in now.dropped.items() if i not in old}):
            now = self.manifest()
        return len(old)

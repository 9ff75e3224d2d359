"""Archive, compaction and retention of an event store. The plans are pure functions of the manifest."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from ..sources.schema import TIME
from ..sources.store import ARCHIVE, GRACE, HOT, EventStore, Segment

ARCHIVE_ROWS = 122_880
COMPACT_BYTES = 128 << 20
#: Rows of a piece of a merged segment, at most about: rows that compress well take many times their bytes while they are sorted.
PIECE_ROWS = 500_000
LIMIT_BYTES = 10 << 30


def limit_bytes(environ: Mapping[str, str] = os.environ) -> int:
    """The store's limit, from STORAGE_LIMIT_GB where that is set."""
    return int(float(environ["STORAGE_LIMIT_GB"]) * (1 << 30)) if environ.get("STORAGE_LIMIT_GB") else LIMIT_BYTES


def _by_time(segments: Iterable[Segment]) -> list[Segment]:
    return sorted(segments, key=lambda s: (s.min_us is not None, s.min_us or 0, s.id))


def plan_archive(segments: Iterable[Segment], threshold: int = ARCHIVE_ROWS) -> list[Segment]:
    """All hot segments, once they hold more rows than the threshold."""
    hot = [s for s in segments if s.tier == HOT]
    return hot if sum(s.rows for s in hot) > threshold else []


def plan_compaction(segments: Iterable[Segment], target: int = COMPACT_BYTES) -> list[list[Segment]]:
    """Runs of small archived segments, by time, that become one.

    A segment of the target size closes the run before it, which is merged if it holds more than one segment and
    more bytes than the target; the last run is merged if it holds more than one.
    """
    plans, run = [], []
    for segment in _by_time(s for s in segments if s.tier == ARCHIVE):
        if segment.bytes < target:
            run.append(segment)
            continue
        if len(run) > 1 and sum(s.bytes for s in run) > target:
            plans.append(run)
        run = []
    return plans + ([run] if len(run) > 1 else [])


def plan_retention(segments: Iterable[Segment], limit: int = LIMIT_BYTES) -> list[Segment]:
    """The oldest archived segments that have to go until the store fits the limit."""
    every = list(segments)
    total, gone = sum(s.bytes for s in every), []
    for segment in _by_time(s for s in every if s.tier == ARCHIVE):
        if total <= limit:
            break
        gone.append(segment)
        total -= segment.bytes
    return gone


def merge(store: EventStore, segments: list[Segment]) -> Segment | None:
    """Write the segments' rows as one archived segment, sorted by time, and publish the exchange."""
    rows = store.rows_of(*[s.id for s in segments])
    parts = max(1, -(-sum(s.bytes for s in segments) // COMPACT_BYTES), -(-sum(s.rows for s in segments) // PIECE_ROWS))
    merged = store.write_segment(rows.repartitionByRange(parts, TIME).sortWithinPartitions(TIME), ARCHIVE)
    if store.replace_segments(segments, merged):
        return merged
    if merged:  # another process has merged or dropped one of them
        store.delete_segment(merged.id)
    return None


def archive(store: EventStore, threshold: int = ARCHIVE_ROWS) -> Segment | None:
    plan = plan_archive(store.manifest().segments, threshold)
    return merge(store, plan) if plan else None


def retain(store: EventStore, limit: int = LIMIT_BYTES) -> int:
    gone = plan_retention(store.manifest().segments, limit)
    return len(gone) if gone and store.replace_segments(gone, None) else 0


def compact(store: EventStore, target: int = COMPACT_BYTES) -> int:
    return sum(merge(store, plan) is not None for plan in plan_compaction(store.manifest().segments, target))


def tick(store: EventStore, limit: int | None = None, grace: float = GRACE) -> None:
    """What is due each minute: archive, then retention, then compaction, then the files whose time of grace is over.

    It may run beside appends and queries.
    """
    archive(store)
    retain(store, limit_bytes() if limit is None else limit)
    compact(store)
    store.vacuum(grace)

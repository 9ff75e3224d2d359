"""Mergeable sketches by hour, beside each archived segment, so that a window's distinct counts and quantiles need no scan.

A segment's sketches are a row for each hour of its events: the number of events, a HyperLogLog sketch for each column of ``DISTINCT``
and a KLL sketch for each measure of ``MEASURES``. A window merges those of the hours that lie in it whole, and sketches the rows of the rest: of
the hours at its ends, and of segments that have no sketches, as the hot ones. With ``LG_K`` 12 a distinct count is within 5 % with
probability 0.997 (three standard errors), and exact up to a few hundred values; a quantile's rank is within 2.7 % with about the same
probability (twice the sketch's own bound), and exact for up to 200 values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time_bucket import time_bucket, width_seconds
from .schema import TIME

if TYPE_CHECKING:
    from .store import EventStore, Segment

HOUR = "1 hour"
LG_K = 12
#: Distinct values that are counted, and measures whose quantiles are taken, by name.
DISTINCT = {"objects": "involvedObject.name", "reasons": "reason", "namespaces": "metadata.namespace", "hosts": "source.host", "components": "source.component"}
MEASURES = {"count": "CAST(count AS DOUBLE)", "seconds": f"(unix_micros({TIME}) - unix_micros(firstTimestamp)) / 1e6D"}


def _aggregates(distinct: Sequence[str], measures: Sequence[str]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.hll_sketch_agg(F.col(DISTINCT[d]), F.lit(LG_K)).alias(f"distinct_{d}") for d in distinct], *[F.kll_sketch_agg_double(F.expr(MEASURES[m])).alias(f"measure_{m}") for m in measures]]


def sketched(events: DataFrame, distinct: Sequence[str] = tuple(DISTINCT), measures: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """A row of sketches for each hour: hour, n, distinct_*, measure_*. Events without a time are left out, as they lie in no window."""
    return events.where(F.col(TIME).isNotNull()).groupBy(time_bucket(TIME, HOUR).alias("hour")).agg(*_aggregates(distinct, measures))


def in_window(store: EventStore, start: datetime, end: datetime, distinct: Sequence[str], measures: Sequence[str]) -> tuple[DataFrame, list[Segment], list[Segment]]:
    """Sketches of a window's events; the segments whose sketches and those whose rows are read for it."""
    from .store import NoDataSources, instant, micros

    low, high, hour = micros(start), micros(end), width_seconds(HOUR) * 1_000_000
    whole = (-(-low // hour) * hour, (high + 1) // hour * hour)  # from the first hour to the end of the last one; both window ends count
    chosen = store.relevant(start, end)
    if not chosen:
        raise NoDataSources("no data lies in the query's time range")
    merged = [s for s in chosen if s.sketched and whole[0] < whole[1] and s.overlaps(whole[0], whole[1] - 1)]
    taken = {s.id for s in merged}
    ends = [s for s in merged if s.min_us is None or s.max_us is None or s.min_us < whole[0] or s.max_us >= whole[1]]
    scanned = [s for s in chosen if s.id not in taken]
    columns = ["hour", "n", *[f"distinct_{d}" for d in distinct], *[f"measure_{m}" for m in measures]]
    parts = []
    inside = lambda name: F.col(name).between(instant(low), instant(high))
    of_whole = lambda name: (F.col(name) >= instant(whole[0])) & (F.col(name) < instant(whole[1]))
    if merged:
        parts.append(store.spark.read.parquet(*[store.sketch_path(s.id) for s in merged]).where(of_whole("hour")))
    if ends:
        parts.append(sketched(store.rows_of(*[s.id for s in ends]).where(inside(TIME) & ~of_whole(TIME)), distinct, measures))
    if scanned:
        parts.append(sketched(store.rows_of(*[s.id for s in scanned]).where(inside(TIME)), distinct, measures))
    out = parts[0].select(columns)
    for part in parts[1:]:
        out = out.union(part.select(columns))
    return out, merged, [*ends, *scanned]


def exact_distinct(store: EventStore, start: datetime, end: datetime, distinct: Sequence[str], width: str) -> DataFrame:
    """A column ``<name>_distinct`` for each name, by time bucket (``bucket``): exact, from the window's rows, of which only these columns are read.

    Equal values of a bucket are combined before they are shuffled; no set of values has to fit in memory.
    """
    rows, _ = store.events(start, end)
    return rows.groupBy(time_bucket(TIME, width).alias("bucket")).agg(*[F.count_distinct(F.col(DISTINCT[d])).alias(f"{d}_distinct") for d in distinct])


def approximate(store: EventStore, start: datetime, end: datetime, distinct: Sequence[str] = (), quantiles: Mapping[str, Sequence[float]] | None = None, width: str | None = None) -> DataFrame:
    """n, a column ``<name>_distinct`` for each name, and ``<measure>_quantiles``, an array, for each measure: of the window's events, both ends included.

    width: also by time bucket (``bucket``), of hours or multiples of them; without events there are no buckets, and one row
    without width.
    """
    asked = dict(quantiles or {})
    unknown = {*distinct} - {*DISTINCT} | {*asked} - {*MEASURES}
    if unknown:
        raise ValueError(f"not sketched: {', '.join(sorted(unknown))}")
    if width is not None and width_seconds(width) % width_seconds(HOUR):
        raise ValueError("a bucket holds whole hours")
    rows, _, _ = in_window(store, start, end, distinct, tuple(asked))
    counts = [F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{d}")).alias(f"{d}_distinct") for d in distinct]
    merges = [F.kll_merge_agg_double(f"measure_{m}").alias(f"measure_{m}") for m in asked]
    by = [] if width is None else [time_bucket("hour", width).alias("bucket")]
    found = rows.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *counts, *merges)
    of = lambda m: F.when(F.kll_sketch_get_n_double(f"measure_{m}") > 0, F.kll_sketch_get_quantile_double(f"measure_{m}", F.array(*[F.lit(float(q)) for q in asked[m]])))
    return found.select(*(["bucket"] if by else []), "n", *[f"{d}_distinct" for d in distinct], *[of(m).alias(f"{m}_quantiles") for m in asked])

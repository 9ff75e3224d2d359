"""Queries over a time window of an event store, exports and statistics."""

from __future__ import annotations

import gzip
import json
import shutil
import time
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from itertools import count
from typing import Any, BinaryIO

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import figures
from .dialect import VIEW, Asof, Spark, candidates
from .operators.asof import asof_join
from .session import request_session
from .sources import files, sketches
from .sources.schema import KEY, TIME
from .sources.store import EventStore

JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class NotAQuery(ValueError):
    """The text is not one query over $events."""


@dataclass
class QueryResult:
    results: list[dict[str, Any]]
    duration_ms: int
    files: list[dict[str, Any]]
    total_files_size_bytes: int


class TooManyRows(ValueError):
    """The answer is larger than one response may be."""


#: Rows of an answer; larger results are for ``export_files``.
MOST_ROWS = 100_000


def checked(df: DataFrame) -> DataFrame:
    """The frame, if its plan reads nothing but the view and calls no Java method by name. Nothing has been run by then."""

    def walk(node: Any) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x)
        elif isinstance(node, dict):
            kind = str(node.get("class", "")).rpartition(".")[2]
            if kind == "CallMethodViaReflection":
                raise NotAQuery("functions that call Java methods are refused")
            # a view or table of the catalogue stands under an alias that names its database
            if kind == "SubqueryAlias" and node["identifier"].get("qualifier") not in (None, "[]", []) or kind in ("DataSourceV2Relation", "HiveTableRelation"):
                raise NotAQuery("only $events can be read")
            for x in node.values():
                walk(x)

    walk(json.loads(df._jdf.queryExecution().analyzed().toJSON()))
    return df


def analysed(session: SparkSession, text: str) -> DataFrame:
    """The text's frame, without rows: it can stand in brackets as a subquery, and reads nothing but the view."""
    return checked(session.sql(f"SELECT * FROM (\n{text}\n) LIMIT 0"))


def asking(session: SparkSession) -> Spark:
    """What the dialect asks of a session."""
    views = count()

    def asof_view(left: str, right: str, join: Asof) -> str:
        sides = [session.table(VIEW).limit(0)] * 2
        for k, text in enumerate((left, right)):
            analysed(session, text)
            sides[k] = session.sql(text)
        names = [f"key{n}" for n in range(len(join.keys))]
        packed = [side.select(*[F.col(pair[k]).alias(n) for pair, n in zip(join.keys, names, strict=True)], F.col(join.times[k]).alias("at"), F.struct(*side.columns).alias(name)) for k, (side, name) in enumerate(zip(sides, (join.left, join.right), strict=True))]
        if join.left.lower() == join.right.lower():
            raise NotAQuery("the sides of an ASOF join have one name")
        day = F.date_trunc("day", "at") if packed[0].schema["at"].dataType.typeName().startswith("timestamp") else None
        met = asof_join(packed[0], packed[1], names, "at", day, join.strict)
        if not join.outer:
            met = met.where(F.col(join.right).isNotNull())
        held = Counter(c.lower() for side in sides for c in side.columns)
        merged = {x.lower() for x, _ in (*join.keys, join.times)} if join.using else set()
        alone = [F.col(f"{name}.`{c}`").alias(c) for k, (side, name) in enumerate(zip(sides, (join.left, join.right), strict=True)) for c in side.columns if c.lower() not in (join.left.lower(), join.right.lower()) and (held[c.lower()] == 1 or not k and c.lower() in merged)]
        view = f"asof_{next(views)}"
        met.select(join.left, join.right, *alone).createOrReplaceTempView(view)
        return view

    return Spark(lambda text: analysed(session, text).columns, asof_view)


def json_rows(df: DataFrame) -> DataFrame:
    """A column ``value``: each row as JSON, nulls included. Serialised in the JVM, which knows all times."""
    twice = [name for name, n in Counter(df.columns).items() if n > 1]
    if twice:
        raise NotAQuery(f"columns of the same name: {', '.join(twice)}")
    return df.select(F.to_json(F.struct("*"), JSON).alias("value"))


@dataclass
class Members:
    """The gzip members of an export: path and size of each, and the number of rows in all."""

    parts: list[tuple[str, int]]
    rows: int

    @property
    def size(self) -> int:
        return sum(size for _, size in self.parts) or len(NOTHING)

    def pass_on(self, out: BinaryIO) -> None:
        for path, _ in self.parts:
            with files.open_input(path) as stream:
                shutil.copyfileobj(stream, out, 1 << 20)
        if not self.parts:
            out.write(NOTHING)


#: A gzipped empty file.
NOTHING = gzip.compress(b"", mtime=0)


class Engine:
    def __init__(self, spark: SparkSession, store: EventStore) -> None:
        self.spark, self.store = spark, store

    def frame(self, sql: str, start: datetime, end: datetime) -> tuple[DataFrame, list]:
        """The query's result, lazily, and the segments it reads.

        The session of the request has one view and opens no files by name. Only what can stand in
        parentheses as a subquery is run, so commands are refused before they run; so are plans that read catalogue
        tables or call Java methods.
        """
        session = request_session(self.spark)
        events, segments = self.store.events(start, end, session)
        events.createOrReplaceTempView(VIEW)
        failed: Exception | None = None
        try:
            for text in candidates(sql, asking(session)):
                try:
                    analysed(session, text)
                    return session.sql(text), segments
                except AnalysisException as error:
                    failed = failed or error
        except Exception as error:
            raise NotAQuery(str(error)) from error
        raise NotAQuery(str(failed)) from failed

    def query(self, sql: str, start: datetime, end: datetime, most_rows: int = MOST_ROWS) -> QueryResult:
        """The whole answer; TooManyRows if it has more than most_rows, as it is gathered in the driver."""
        frame, segments = self.frame(sql, start, end)
        began = time.monotonic()
        rows = [json.loads(r["value"]) for r in json_rows(frame).limit(most_rows + 1).collect()]
        if len(rows) > most_rows:
            raise TooManyRows(f"the answer has more than {most_rows} rows; add a LIMIT or export it")
        took = round((time.monotonic() - began) * 1000)
        return QueryResult(rows, took, [{"path": self.store.path(s.id), "size": s.bytes} for s in segments], sum(s.bytes for s in segments))

    def ordered(self, start: datetime, end: datetime, where: str = "") -> DataFrame:
        """The window's events by time, then by key; where is one SQL expression."""
        session = request_session(self.spark)
        events, _ = self.store.events(start, end, session)
        return (checked(events.where(where)) if where.strip() else events).orderBy(TIME, KEY)

    def export(self, target: str | BinaryIO, start: datetime, end: datetime, where: str = "") -> int:
        """Write the window's events, by time, to one gzipped file or stream, a JSON object a line. Gives the number of rows.

        Executors sort and write the parts; the driver only passes on their bytes, a block at a time.
        """
        with self.members(start, end, where) as found:
            if isinstance(target, str):
                with open(target, "wb") as out:
                    found.pass_on(out)
            else:
                found.pass_on(target)
        return found.rows

    @contextmanager
    def members(self, start: datetime, end: datetime, where: str = "") -> Iterator[Members]:
        """The export as gzip members, in order, which together are one gzipped file; they are deleted afterwards."""
        path = files.new_path(self.spark, "export")
        try:
            rows = self.export_files(path, start, end, where)
            yield Members(files.parts_in(path), rows)
        finally:
            files.remove(self.spark, path)

    def export_files(self, path: str, start: datetime, end: datetime, where: str = "") -> int:
        """The same as a folder of gzipped part files, which executors write. The parts' order is that of the events. Gives the number of rows."""
        seen = Observation()
        json_rows(self.ordered(start, end, where)).observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "gzip").text(path)
        return seen.get["n"]

    def approximate(self, start: datetime, end: datetime, distinct: Sequence[str] = (), quantiles: Mapping[str, Sequence[float]] | None = None, width: str | None = None) -> DataFrame:
        """Distinct counts and quantiles of a window by the segments' sketches: see ``sources.sketches``."""
        return sketches.approximate(self.store, start, end, distinct, quantiles, width)

    def stats(self) -> dict[str, Any]:
        manifest, errors = self.store.manifest(), []
        try:
            size = files.size_of(self.store.root)
        except OSError as error:
            size = 0
            errors.append(f"size of the data folder: {error}")
        try:
            folders = figures.local_folders(self.spark)
        except Exception as error:
            folders = []
            errors.append(f"temporary files: {error}")
        tracker = self.spark.sparkContext.statusTracker()
        tiers = Counter({s.tier: 0 for s in manifest.segments})
        for s in manifest.segments:
            tiers[s.tier] += s.rows
        return {
            "data_dir": self.store.root,
            "data_dir_size": size,
            "segments": len(manifest.segments),
            "rows": dict(tiers),
            "batches": manifest.batches,
            "memory": figures.executors(self.spark),
            "temporary_files": {"files": sum(f["files"] for f in folders), "bytes": sum(f["bytes"] for f in folders), "folders": folders},
            "active_jobs": len(tracker.getActiveJobsIds()),
            "active_streams": [q.name for q in self.spark.streams.active],
            "tables_cached": [t.name for t in self.spark.catalog.listTables() if self.spark.catalog.isCached(t.name)],
            "errors": errors,
        }

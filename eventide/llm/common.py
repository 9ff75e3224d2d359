"""What the operators share: shared storage, row keys, joins of few rows, and Arrow map helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: Rows and bytes of an Arrow batch. Texts may be long, and a task holds a batch in the JVM and in Python.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Make the Arrow batches of this session small, for good, unless they are so already."""
    for setting, most in BATCH_LIMITS.items():
        if not 0 < int(spark.conf.get(setting).rstrip("b")) <= most:
            spark.conf.set(setting, str(most))


#: The list of folders made so far, where somebody keeps one.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = files.new_path(spark, name)
    if (held := _made.get()) is not None:
        held.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that writes a table and reads it again. Each call deletes the folders that were made before it and
    that it has not written itself, so what is passed to it must be all that is still needed."""
    held: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        while len(held) > 1:
            files.remove(spark, held.pop(0))
        return out

    before = _made.set(held)
    try:
        yield keep
    finally:
        _made.reset(before)


def tidied(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, which writes its result and deletes what else it has written on its way, if it has written anything."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark) as written:
            out = query(spark, sf_dir)
            return written(out, "result") if _made.get() else out

    return run


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table that may be sent to every executor; above, it is shuffled instead.
BROADCAST_ROWS = 1_000_000


def small(narrow: DataFrame) -> bool:
    """Whether a written table of a few numbers a row may be broadcast."""
    return narrow.count() <= BROADCAST_ROWS


def sized(narrow: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it has been counted and is small."""
    return F.broadcast(narrow) if small(narrow) else narrow


def free_name(columns: Iterable[str], name: str) -> str:
    """A column name like this one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A set of keys is a bitmap of a fixed size, SLOTS rows of 4096 bytes or 8 MB, however many keys there are.
SLOTS, SLOT_BITS = 2048, 32768


def marked(rows: DataFrame, keys: DataFrame, names: list[str], flag: str) -> DataFrame:
    """The rows with a boolean column: false only where no row of keys has the same values in these columns, while true may err.

    What is broadcast is a bitmap of hashes, whose size does not depend on the number of keys; no row is shuffled.
    """
    hashed = F.pmod(F.xxhash64(*names), F.lit(SLOTS * SLOT_BITS))
    bit, slot, bits = (free_name([*rows.columns, flag], n) for n in ("_bit", "_slot", "_bits"))
    of_slot = F.expr(f"CAST({bit} DIV {SLOT_BITS} AS INT)")
    bitmap = keys.select(hashed.alias(bit)).groupBy(of_slot.alias(slot)).agg(F.bitmap_construct_agg(F.col(bit) % SLOT_BITS).alias(bits))
    hashed_rows = rows.withColumn(bit, hashed).withColumn(f"{slot}_", of_slot)
    joined = hashed_rows.join(F.broadcast(bitmap), F.col(f"{slot}_") == F.col(slot), "left")
    place = (F.col(bit) % SLOT_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(flag, F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))).drop(bit, slot, f"{slot}_", bits)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_column(text_col: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def long_id(id_col: str = "doc_id") -> Column:
    """The id as a long, whatever kind of integer the table has."""
    return F.col(id_col).cast("long").alias(id_col)


def fold_of(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts (a null id: fold of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most so many rows, to bound what a task holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_by_size(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose column has about so many bytes at most, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy().cumsum()
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            stop = max(at + 1, int(sizes.searchsorted(before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Key and rows of each run of equal keys (numbers); a run may go on in the next batch."""
    at, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch[c].to_numpy() for c in keys], 1)
        bounds = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(values[a].tolist())
            if key != at:
                if parts:
                    yield at, pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                at, parts = key, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield at, pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def keep_rows(docs: DataFrame, keep: Callable[[list[str]], "object"], text_col: str = "text") -> DataFrame:
    """The rows for whose texts (null: empty) the function says true, with all their columns."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array([bool(x) for x in keep(texts)], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(task, docs.schema)

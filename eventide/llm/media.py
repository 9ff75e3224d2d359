"""Media columns: images in archives, written and read by a custom Spark data source.

``media_archive`` keeps binary members in archive files of one folder. A write task appends its members
to a file of its own and, beside it, the members' byte offsets; the commit lists the files of the
successful tasks in a manifest, so what a lost task left behind is never read. A read plans byte ranges
over the files: a partition streams the members that begin in its range, as Arrow batches of bounded
size. A member that comes short or does not match its checksum is read again by its offset, on its own, a few
times; then the read fails. An overwriting commit deletes the manifests before it, so their files are no longer read. Files
are reached through pyarrow's file systems.

The images are greyscale PNG files of 8-bit samples, 192 to a row. A text's payload is its UTF-8 bytes, padded
with blanks to full rows; the number of bytes before padding stands in a text chunk.

Defined cases: a null text counts as empty, which gives one row of blanks; a null doc_id and repeated rows are kept
as they are; equal texts give equal images; any length of text is stored whole; other columns are not looked at; an empty
table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..sources import files
from . import common

WIDTH = 192
HEADER = struct.Struct("<4s?qQI")  # mark, whether there is an id, id, bytes, CRC-32
MARK = b"MEDM"
SPLIT_BYTES, BATCH_BYTES, TRIES = 16 << 20, 4 << 20, 4
#: Offsets of an index file that are read at once.
INDEX_ROWS = 8192
SCHEMA = "doc_id long, media binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    """Members of a file that begin at start or later and before stop."""

    name: str
    start: int
    stop: int


class MediaArchive(DataSource):
    """Options: path; split_bytes for reads."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"], overwrite)

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = files.place(self.path)
        fs.create_dir(root, recursive=True)
        name, offsets, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], 0
        with fs.open_output_stream(f"{root}/{name}.arc") as out:
            for batch in iterator:
                for doc_id, media in zip(batch["doc_id"].to_pylist(), batch["media"], strict=True):
                    body = media.as_buffer()
                    offsets.append(at)
                    out.write(HEADER.pack(MARK, doc_id is not None, doc_id or 0, len(body), zlib.crc32(body)))
                    out.write(body)
                    at += HEADER.size + len(body)
        with fs.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.array(offsets, "<i8").tobytes())
        return Written([(name, at)] if offsets else [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = files.place(self.path)
        fs.create_dir(root, recursive=True)
        before = manifests(fs, root)
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        if self.overwrite:
            for path in before:
                fs.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files that no manifest lists are never read."""


def manifests(fs: FileSystem, root: str) -> list[str]:
    return sorted(i.path for i in fs.get_file_info(FileSelector(root)) if i.base_name.startswith("manifest-"))


def offsets_between(fs: FileSystem, path: str, start: int, stop: int) -> np.ndarray:
    """The offsets of an index file from start on and before stop. Of a long file only a part is read, found by halving."""
    with fs.open_input_file(path) as index:
        n = index.size() // 8

        def first_from(bound: int) -> int:
            low, high = 0, n
            while high - low > INDEX_ROWS:
                middle = (low + high) // 2
                index.seek(8 * middle)
                low, high = (middle + 1, high) if np.frombuffer(index.read(8), "<i8")[0] < bound else (low, middle)
            index.seek(8 * low)
            return low + int(np.searchsorted(np.frombuffer(index.read(8 * (high - low)), "<i8"), bound))

        a, b = first_from(start), first_from(stop)
        index.seek(8 * a)
        return np.frombuffer(index.read(8 * (b - a)), "<i8")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[InputPartition]:
        fs, root = files.place(self.path)
        listed: list[tuple[str, int]] = []
        for path in manifests(fs, root):
            with fs.open_input_stream(path) as stream:
                listed += json.loads(stream.read())
        ranges = [Range(name, start, start + self.split_bytes) for name, size in listed for start in range(0, size, self.split_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = files.place(self.path)
        mine = offsets_between(fs, f"{root}/{partition.name}.idx", partition.start, partition.stop)
        ids: list[int | None] = []
        media: list[bytes] = []
        held = 0
        for doc_id, body in members(fs, f"{root}/{partition.name}.arc", mine.tolist()):
            ids.append(doc_id)
            media.append(body)
            held += len(body)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], schema=ARROW)
                ids, media, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], schema=ARROW)


def members(fs: FileSystem, path: str, offsets: list[int]) -> Iterator[tuple[int | None, bytes]]:
    """The members at these neighbouring offsets, as a stream that is opened again after a member that had to be retried."""
    done = 0
    while done < len(offsets):
        with fs.open_input_file(path) as stream:
            stream.seek(offsets[done])
            while done < len(offsets):
                try:
                    found = read_member(stream)
                except (OSError, ValueError):
                    break
                yield found
                done += 1
        if done < len(offsets):
            yield retry_member(fs, path, offsets[done])
            done += 1


def read_member(stream) -> tuple[int | None, bytes]:
    """The member at the stream's place; raises ValueError if it is not whole."""
    head = stream.read(HEADER.size)
    if len(head) < HEADER.size:
        raise ValueError("the header came short")
    mark, has_id, doc_id, size, crc = HEADER.unpack(head)
    if mark != MARK:
        raise ValueError("no member begins here")
    body = stream.read(size)
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("the member came short or changed")
    return doc_id if has_id else None, body


def retry_member(fs: FileSystem, path: str, offset: int, tries: int = TRIES, wait: float = 0.2) -> tuple[int | None, bytes]:
    """Read one member again by its offset, through a new handle each time."""
    for n in range(tries):
        try:
            with fs.open_input_file(path) as stream:
                stream.seek(offset)
                return read_member(stream)
        except (OSError, ValueError):
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)
    raise AssertionError


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


SIGNATURE = b"\x89PNG\r\n\x1a\n"


def to_image(data: bytes) -> bytes:
    """A PNG file with these bytes as its samples, padded with blanks to full rows."""
    rows = max(1, -(-len(data) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = np.frombuffer(data.ljust(rows * WIDTH, b" "), np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_image(media: bytes) -> tuple[int, np.ndarray]:
    """Bytes before padding, and the samples as rows, of a file that to_image made."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, n_bytes, packed, shape = 8, 0, b"", (0, 0)
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if depth != 8 or colour != 0:
                raise ValueError("not 8-bit greyscale")
            shape = height, width
        elif kind == b"tEXt":
            n_bytes = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            packed += body
        at += size + 12
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter that to_image never writes")
    return n_bytes, lines[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Mean and deviation of the samples, their mean step along rows, and the share of each eighth of the range."""
    counts = np.bincount(samples.ravel(), minlength=256)
    values, n = np.arange(256), samples.size
    mean = float(counts @ values) / n
    deviation = max(float(counts @ values**2) / n - mean * mean, 0.0) ** 0.5
    step = float(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum()) / n
    shares = ",".join(f"{x / n:.4f}" for x in counts.reshape(8, 32).sum(1))
    return f"mean={mean:.4f};deviation={deviation:.4f};step={step:.4f};shares={shares}"


def write_images(docs: DataFrame, path: str) -> None:
    """Store each document's text as an image in the archive folder."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            media = [to_image((x or "").encode("utf-8", "surrogatepass")) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(media, pa.binary())], schema=ARROW)

    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(common.long_id(), "text").mapInArrow(task, SCHEMA).write.format("media_archive").mode("append").save(path)


def read_images(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("split_bytes", split_bytes).load(path)


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe_images(images: DataFrame) -> DataFrame:
    """Decode the stored images and describe them."""
    names, kinds = [x.split()[0] for x in RESULT.split(", ")], [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            rows = []
            for doc_id, media in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist(), strict=True):
                n_bytes, samples = from_image(media)
                payload = samples.tobytes()
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return images.mapInArrow(task, RESULT)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "media")
    write_images(common.documents(spark, sf_dir).select("doc_id", "text"), path)
    return describe_images(read_images(spark, path))

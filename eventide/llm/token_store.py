"""Token ids in a binary format: one zstandard frame a document, with a dictionary for all of them.

The store is a folder with two Parquet tables, so it needs nothing but Spark's file systems: ``dictionary``
(one row: the trained dictionary, its SHA-256 and the end id) and ``blocks`` (a shard's frames one after
the other, with each document's byte offset and number of ids: the offset index). Documents lie in
ascending doc_id order over the shards. To read a few documents, the blocks' first and last ids pick the
blocks, and the offsets the frames: nothing else is decompressed.

Texts are encoded and compressed where they are read. The frames are written, and it is they that are dealt by range;
a running number in the range's key lets rows of one doc_id lie in several shards.

Defined cases: a null text counts as empty (its only id is the end id); a null doc_id sorts first;
rows that share a doc_id are all kept, next to each other, in the order of their texts' hashes (equal rows are alike, so
their order is of no account); texts of any length are encoded whole; extra columns are not looked at; an empty
table gives an empty store with a dictionary of no samples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from . import common
from .encoding import text_encoder

END_ID = 1
#: Bytes of a trained dictionary, documents it is trained on, and the longest of them in bytes of text.
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 64 << 10, 1000, 16 << 10
#: Bytes of frames after which a block ends.
BLOCK_BYTES = 2 << 20
#: Bytes of frames of a shard, about, where the session's shuffle partitions would give larger ones.
SHARD_BYTES = 512 << 20
LEVEL = 3
BLOCKS = "shard int, block int, in_shard long, first_id long, last_id long, dictionary_sha256 string, body binary, doc_ids array<long>, offsets array<long>, n_tokens array<long>"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """A dictionary from about SAMPLES different documents, twice as many at most, chosen by a hash. It changes sizes, not results."""
    text = common.text_column()
    share = max(1, -(-docs.count() // SAMPLES))
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch in common.slices(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array([encoder.encode(x) + end for x in batch["text"].to_pylist()], pa.binary())], names=["ids"])

    hashed = docs.select(F.xxhash64("doc_id", text).alias("hash"), text.alias("text"))
    chosen = hashed.where((F.pmod("hash", F.lit(share)) == 0) & (F.octet_length("text") <= SAMPLE_BYTES)).groupBy("hash").agg(F.first("text").alias("text"))
    samples = [bytes(row["ids"]) for row in chosen.orderBy("hash").limit(2 * SAMPLES).select("text").mapInArrow(task, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every document and write the store."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary), end_id)], "sha256 string, dictionary binary, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = text_encoder(tokenizer), TaskContext.get().partitionId() << 33
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        for batch in common.slices(batches, 512):
            ids = [encoder.encode(text) + end for text in batch["text"].to_pylist()]
            counts, numbers = [len(x) // 4 for x in ids], range(number, number + len(ids))
            number += len(ids)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["hash"], pa.array(numbers, pa.int64()), pa.array(counts, pa.int64()), pa.array(map(compress, ids), pa.binary())], names=["doc_id", "hash", "number", "n_tokens", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, frames = TaskContext.get().partitionId(), []
        doc_ids: list[int | None] = []
        counts: list[int] = []
        held = block = in_shard = 0

        def closed() -> pa.RecordBatch:
            offsets, known = np.cumsum([0, *map(len, frames)]), [i for i in doc_ids if i is not None]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (in_shard, pa.int64()), (known[0] if known else None, pa.int64()), (known[-1] if known else None, pa.int64()), (digest, pa.string()), (b"".join(frames), pa.binary()), (doc_ids, pa.list_(pa.int64())), (offsets.tolist(), pa.list_(pa.int64())), (counts, pa.list_(pa.int64())))], names=["shard", "block", "in_shard", "first_id", "last_id", "dictionary_sha256", "body", "doc_ids", "offsets", "n_tokens"])

        for batch in batches:
            for doc_id, count, frame in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["frame"].to_pylist(), strict=True):
                frames.append(frame)
                doc_ids.append(doc_id)
                counts.append(count)
                held += len(frame)
                if held >= block_bytes:
                    yield closed()
                    in_shard += sum(counts)
                    frames, doc_ids, counts, held, block = [], [], [], 0, block + 1
        if frames:
            yield closed()

    text = common.text_column()
    frames = docs.select(common.long_id(), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(encoded, "doc_id long, hash long, number long, n_tokens long, frame binary")
    held, key = common.new_path(spark, "frames"), ["doc_id", "hash", "number"]
    frames.write.option("compression", "none").parquet(held)
    shards = -(-files.bytes_in(spark, held) // shard_bytes)
    number = [shards] if shards > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    ordered = spark.read.schema(frames.schema).parquet(held).repartitionByRange(*number, *key).sortWithinPartitions(*key).select("doc_id", "n_tokens", "frame")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    files.remove(spark, held)


def read_some(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, start and ids of these documents only."""
    wanted = sorted(set(doc_ids))
    if not wanted:
        return read_store(spark, path).drop("n_tokens").limit(0)
    # the first two comparisons reach the files' statistics
    near = (F.col("first_id") <= wanted[-1]) & (F.col("last_id") >= wanted[0]) & F.exists(F.lit(wanted).cast("array<long>"), lambda i: i.between(F.col("first_id"), F.col("last_id")))
    return _read(spark, path, lambda ids: ids, "ids binary", pa.binary(), near, frozenset(wanted)).drop("n_tokens")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32 bytes)."""
    return _read(spark, path, lambda ids: ids, "ids binary", pa.binary())


def _read(spark: SparkSession, path: str, value, column: str, kind: pa.DataType, near: Column | None = None, wanted: frozenset[int] | None = None) -> DataFrame:
    held = spark.read.parquet(f"{path}/dictionary").first()
    digest, dictionary = held["sha256"], bytes(held["dictionary"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # A block knows how many ids of its shard come before it; a row per shard says how many come before the shard. The
    # window over these rows is one task, whose rows are as many as the store has shards.
    ends = blocks.groupBy("shard").agg(F.max(F.col("in_shard") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = ends.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    starts = common.sized(common.materialize(shards, "shards"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress
        names = ["doc_id", "start", "n_tokens", column.split()[0]]
        for batch in common.slices(batches, 1):
            row = {name: batch[name][0] for name in ("dictionary_sha256", "body", "doc_ids", "offsets", "n_tokens", "in_shard", "shard_start")}
            if row["dictionary_sha256"].as_py() != digest:
                raise ValueError("a block was written with another dictionary")
            body, offsets, counts = memoryview(row["body"].as_buffer()), row["offsets"].values.to_numpy(), row["n_tokens"].values.to_numpy()
            doc_ids = row["doc_ids"].values
            start = row["shard_start"].as_py() + row["in_shard"].as_py() + np.concatenate([[0], np.cumsum(counts)])[:-1]
            held = range(len(counts)) if wanted is None else [k for k, i in enumerate(doc_ids.to_pylist()) if i in wanted]
            ids = [value(expand(body[offsets[k] : offsets[k + 1]])) for k in held]
            found = pa.RecordBatch.from_arrays([doc_ids, pa.array(start, pa.int64()), pa.array(counts, pa.int64())], names=names[:3]).take(pa.array(held, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(ids, kind)], names=names)

    chosen = blocks if near is None else blocks.where(near)
    return chosen.join(starts, "shard").mapInArrow(task, f"doc_id long, start long, n_tokens long, {column}")


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the store for all documents, read it back, and return each document's digest."""
    path = common.new_path(spark, "token-store")
    write_store(common.documents(spark, sf_dir), path)
    return _read(spark, path, zlib.crc32, "ids_crc32 long", pa.int64())

"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Only the histogram of piece lengths, at most ``capacity`` numbers whatever the input, reaches the
driver. It enumerates the patterns of up to three lengths that fill a sequence exactly, fits their
repeat counts by non-negative least squares (projected accelerated gradient), rounds them to what the
histogram holds, and packs the rest best-fit by decreasing length, all on counts. Pieces then find
their place by their rank among the pieces of their length; ranks come from counts per written
partition, so that no length, however frequent, meets in one task.

Defined cases: a null text counts as empty (its one piece is the end id); equal rows and rows that
share a doc_id are packed one by one; which of the pieces of one length gets which place is not said; a null doc_id
stays null; texts of any length are cut whole; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoding import text_encoder

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's pieces, with the piece's running number among those of its length in its task.

    A document longer than the capacity is cut from its end, so only its first piece may be shorter.
    """
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = text_encoder(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in common.slices(batches, 512):
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                total = len(ids) // 4
                bounds = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    return docs.select("doc_id", common.text_column().alias("text")).mapInArrow(task, PIECES)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def enumerate_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the capacity, of lengths that are present."""
    held = np.zeros(capacity + 1, bool)
    held[present] = True
    held[0] = True
    found = []
    for a in np.flatnonzero(held):
        b = np.arange(a, (capacity - a) // 2 + 1)
        c = capacity - a - b
        keep = held[b] & held[c] & (b > 0)
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts x with sum over patterns of x near the histogram."""
    size = len(histogram)

    def spread(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, k], x, size) for k in range(3))
        out[0] = 0
        return out

    def gather(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[patterns].sum(1)

    x = y = np.zeros(len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = gather(spread(v))
        v /= max(np.linalg.norm(v), 1e-30)
    step, t = 1 / max(np.linalg.norm(gather(spread(v))) * 1.05, 1e-30), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * gather(spread(y) - histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan_patterns(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, how many sequences have it), using every length exactly as often as the histogram says."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = enumerate_patterns(np.flatnonzero(left), capacity)
    if len(patterns):
        fitted = fit_counts(patterns, left.astype(float))
        for k in np.argsort(-fitted, kind="stable"):
            wanted = int(np.rint(fitted[k]))
            if wanted < 1:
                break
            pattern = tuple(int(x) for x in patterns[k][::-1] if x)
            count = min([wanted, *(int(left[x]) // pattern.count(x) for x in set(pattern))])
            if count:
                plan.append((pattern, count))
                for x in pattern:
                    left[x] -= count
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length, on counts: sequences with the same content are handled together."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    free = np.zeros(capacity + 1, bool)

    def put(space: int, pattern: tuple[int, ...], count: int) -> None:
        bins[space][pattern] = bins[space].get(pattern, 0) + count
        free[space] = True

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                space = length + int(fits[0])
                pattern, held = bins[space].popitem()
                free[space] = bool(bins[space])
                # as many of this length as one sequence takes, so that equal sequences stay together
                per = min(space // length, count)
                use = min(held, count // per)
                if held > use:
                    put(space, pattern, held - use)
                put(space - per * length, pattern + (length,) * per, use)
                count -= per * use
            else:
                per = min(capacity // length, count)
                use = count // per
                put(capacity - per * length, (length,) * per, use)
                count -= per * use
    return [(pattern, count) for space in sorted(bins) for pattern, count in sorted(bins[space].items())]


class Places:
    """For the k-th piece of a length: its sequence and its offset there."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], capacity: int) -> None:
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        sequence = 0
        for pattern, count in plan:
            offset = 0
            for length in pattern:
                runs[length].append((count, sequence, offset))
                offset += length
            sequence += count
        self.sequences = sequence
        flat = [run for of_length in runs for run in of_length]
        counts = np.array([run[0] for run in flat], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1] if len(flat) else np.zeros(0, np.int64)
        self.sequence = np.array([run[1] for run in flat], np.int64)
        self.offset = np.array([run[2] for run in flat], np.int64)
        self.base = np.concatenate([[0], np.cumsum([sum(run[0] for run in of_length) for of_length in runs])])[:-1].astype(np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        run = np.searchsorted(self.first, at, "right") - 1
        return self.sequence[run] + at - self.first[run], self.offset[run]


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = common.materialize(cut_pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each length that a task of the first step has met: small numbers, joined by broadcast as long as they are few
    bases = common.sized(common.materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "bases"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # a row per length, at most the capacity
        histogram[row["length"]] = row["n"]
    places = Places(plan_patterns(histogram, capacity), capacity)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
                columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))

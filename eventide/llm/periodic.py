"""Periodic runs of words, by online dyadic square catching.

Words are appended to a sequence. At each level the sequence is cut into blocks of a power of two, L; a completed
block is a catcher for the periods from 2L to 4L - 1 (those of the lowest level, L = 2, for all below 8). Whenever the last L words
are those of a catcher's block at such a distance, a suffix comparison starts: it goes back from both places as far as the words agree, and
forward with each word that is appended, until two differ. As soon as it spans two periods it is a square; the squares of one
period that overlap are one stretch, which is reported as a run when it ends.

Every square is caught: its first half is at least as long as two blocks less a word, so it holds a whole block. At a
level each place has two catchers to be compared with (four at the lowest), so the work is the number of words times the logarithm of the
longest text, done on whole arrays: many words may be appended at once. Equal hashes only start a comparison; comparisons are
exact. A comparison within a stretch that has a divisor of its distance as period is left out: that stretch is not one of this period.

Texts are independent: a task appends many of them to one sequence, with a different separator, equal to nothing, after each.

Defined cases: a null or empty text, or one without words, has no run; a null doc_id counts as the empty text in the hash;
any length goes through whole, in memory that is proportional to it; repeated rows get equal results, each its own;
other columns are not looked at, whatever their names; an empty table gives an empty result. Runs are at least ``LEAST`` words long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a run at least, and words of a block of the lowest level, which suffices for runs of this length.
LEAST, LOWEST = 12, 2
#: Bytes of texts that make one sequence, and words that are appended at once.
TOGETHER, APPENDED = 1 << 20, 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x.astype(np.uint64) * MULTIPLIER
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class SquareCatcher:
    """Finds the runs of a sequence to which words, given as numbers, are appended.

    longest: no run is longer than this (None: they may be of any length), so higher levels are spared.
    """

    def __init__(self, longest: int | None = None) -> None:
        self.n, self.longest = 0, longest
        self.words, self.sums, self.powers = np.zeros(0, np.int64), np.zeros(1, np.uint64), np.ones(1, np.uint64)
        #: by period, where the comparison that has come to the sequence's end began: from there on words equal those a period before
        self.open: dict[int, int] = {}
        self.closed: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        first, self.n = self.n, self.n + len(words)
        self.grow(words, first)
        ended = self.advance(first)
        #: periods, and first and last words, of squares that reach into what was appended
        squares: dict[int, list[tuple[int, int]]] = {}
        for period, (start, end) in ended.items():
            if end - start >= period:
                squares.setdefault(period, []).append((start - period, end))
        at, gap, size = self.wakes(first)
        order = np.lexsort((at, gap))
        at, gap, size = at[order], gap[order], size[order]
        bounds = [0, *(np.flatnonzero(gap[1:] != gap[:-1]) + 1).tolist(), len(gap)]
        for low, high in zip(bounds, bounds[1:], strict=False):
            if low < high:
                self.compare(int(gap[low]), at[low:high], size[low:high], ended, squares)

    def grow(self, words: np.ndarray, first: int) -> None:
        if self.n > len(self.words):
            room = max(1024, self.n, 2 * first)
            self.words = np.concatenate([self.words[:first], np.zeros(room - first, np.int64)])
            self.sums = np.concatenate([self.sums[: first + 1], np.zeros(room - first, np.uint64)])
            self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(room, MULTIPLIER)]))
        self.words[first : self.n] = words
        np.cumsum(mixed(words) * self.powers[first : self.n], out=self.sums[first + 1 : self.n + 1])
        self.sums[first + 1 : self.n + 1] += self.sums[first]

    def advance(self, first: int) -> dict[int, tuple[int, int]]:
        """Carry on the open comparisons; where each of them stands now."""
        now = {}
        for period, start in list(self.open.items()):
            end = self.forward(first, period)
            now[period] = (start, end)
            if end < self.n:
                del self.open[period]
                self.report(start, end, period)
        return now

    def wakes(self, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the new words complete a copy of a catcher's block: its start, its distance from the block, its length."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        size, most = LOWEST, self.n if self.longest is None else min(self.n, self.longest)
        while size == LOWEST or 4 * size <= most:
            at = np.arange(max(first - size + 1, 1), self.n - size + 1)
            here = self.sums[at + size] - self.sums[at]
            nearest = (at - (1 if size == LOWEST else 2 * size)) // size * size
            for back in range(4 if size == LOWEST else 2):
                block = nearest - back * size
                gap = at - block
                there = np.maximum(block, 0)
                alike = (self.sums[there + size] - self.sums[there]) * self.powers[np.minimum(gap, self.n)] == here
                hit = np.flatnonzero(alike & (block >= 0) & (gap < 4 * size))
                found.append((at[hit], gap[hit], np.full(len(hit), size)))
            size *= 2
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def compare(self, period: int, at: np.ndarray, size: np.ndarray, ended: dict[int, tuple[int, int]], squares: dict[int, list[tuple[int, int]]]) -> None:
        """Start the suffix comparisons of one period, in the order of their places, unless one before has passed there."""
        left = np.ones(len(at), bool)
        periods = np.fromiter(squares, np.int64, len(squares))
        for divisor in periods[(periods < period) & (period % np.maximum(periods, 1) == 0)].tolist():
            for start, end in squares[divisor]:
                left &= (at - period < start) | (at + size > end)
        at, size = at[left], size[left]
        reached, k = ended.get(period, (0, 0))[1], 0
        while True:
            k = max(k, int(at.searchsorted(reached)))
            if k >= len(at):
                return
            end = self.forward(int(at[k]), period)
            if end - at[k] < size[k]:  # only the hashes were equal
                k += 1
                continue
            start, reached = self.backward(int(at[k]), period), end
            if end - start >= period:
                squares.setdefault(period, []).append((start - period, end))
            if end == self.n:
                self.open[period] = start
            else:
                self.report(start, end, period)

    def forward(self, at: int, period: int) -> int:
        """The first place from here on whose word differs from that a period before."""
        step = 16
        while at < self.n:
            stop = min(at + step, self.n)
            differs = self.words[at:stop] != self.words[at - period : stop - period]
            k = int(differs.argmax())
            if differs[k]:
                return at + k
            at, step = stop, 2 * step
        return self.n

    def backward(self, at: int, period: int) -> int:
        """The first of the places that lead here without a word that differs from that a period before."""
        step = 16
        while at > period:
            stop = max(at - step, period)
            differs = (self.words[stop:at] != self.words[stop - period : at - period])[::-1]
            k = int(differs.argmax())
            if differs[k]:
                return at - k
            at, step = stop, 2 * step
        return period

    def report(self, start: int, end: int, period: int) -> None:
        if end - start >= period and end - start + period >= LEAST:
            span = (start - period, end)
            self.closed[span] = min(period, self.closed.get(span, period))

    def runs(self) -> list[Run]:
        """Start, end and smallest period of each run so far, by start, then by period."""
        held, self.closed = self.closed, dict(self.closed)
        for period, start in self.open.items():
            self.report(start, self.n, period)
        found, self.closed = self.closed, held
        return sorted(((start, end, period) for (start, end), period in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(texts: list[list]) -> list[list[Run]]:
    """The runs of each list of words, by one sequence for all of them."""
    numbers: dict = {}
    parts, at, starts = [], 0, []
    for k, words in enumerate(texts):
        part = np.empty(len(words) + 1, np.int64)
        part[:-1] = np.fromiter(map(numbers.setdefault, words, count(at)), np.int64, len(words))
        part[-1] = -1 - k
        parts.append(part)
        starts.append(at)
        at += len(part)
    catcher = SquareCatcher(max(map(len, texts), default=0))
    whole = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    for at in range(0, len(whole), APPENDED):
        catcher.append(whole[at : at + APPENDED])
    found: list[list[Run]] = [[] for _ in texts]
    for start, end, period in catcher.runs():
        k = int(np.searchsorted(starts, start, "right")) - 1
        found[k].append((start - starts[k], end - starts[k], period))
    return found


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run holds after its first period."""
    kept, at = [], 0
    for start, end in sorted((start + period, end) for start, end, period in runs):
        if start > at:
            kept += words[at:start]
        at = max(at, end)
    return kept + words[at:]


def words_of(text: str | None) -> list[bytes]:
    """Stretches without blanks, tabs, line and page feeds, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def looped(words: list, doc_id: int | None) -> list:
    """The words of the audit's documents: those whose hashed id ends in 0 go round in a loop from some word on."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    loop = words[start : start + period]
    return words[:start] + (loop * -(-(n - start) // period))[: n - start]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loops: bool = False) -> DataFrame:
    """Per document: id, runs (start, length, period; by start, then period), collapsed (the words kept, joined by one blank).

    loops: the words are first changed as in ``looped``.
    """
    out = "id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices_by_size(batches, "text", TOGETHER):
            ids = batch["id"].to_pylist()
            texts = [words_of(x) for x in batch["text"].to_pylist()]
            if loops:
                texts = [looped(words, i) for words, i in zip(texts, ids, strict=True)]
            found = runs_of(texts)
            kept = [b" ".join(collapsed(words, runs) if runs else words) for words, runs in zip(texts, found, strict=True)]
            listed = [[{"start": a, "length": b - a, "period": p} for a, b, p in runs] for runs in found]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(listed, kind), pa.array(kept, pa.binary())], names=["id", "runs", "collapsed"])

    common.bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(task, out)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from the runs and the words kept."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.select("id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    length = -F.col("best.less")
    milli = F.expr("(1000 * -best.less) DIV best.period")
    return rows.select(F.col("id").alias("doc_id"), "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(common.documents(spark, sf_dir), loops=True))

"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a dozen numbers. Each is cut into quantile bins, and cyclic boosting of shallow trees,
one feature at a time, round after round, adds up a lookup table per feature; the pairs that explain
most of what is left get a table over two features' bins. A score is the logistic of a sum of table
entries, added up for whole batches at once.

The model is fitted on about ``TRAIN_ROWS`` labelled rows, twice as many at most, chosen by hashes, equal ones once;
everything else covers all rows. Features are computed once for each text, written, and used for both.

Defined cases: a null or empty text has features of its own (all zero) and gets a score; rows with a
null label, with a label but no document, or with several labels that disagree count as they are; a
null doc_id gets a score but no label; with no labelled row at all every score is 0.5, and the pipeline's stage keeps all documents; columns that
are not named here are not looked at; repeated rows get equal scores; texts of any length count whole; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES = ["log_chars", "upper", "digit", "space", "newline", "marks", "symbols", "other", "mean_word", "distinct_words", "long_words", "distinct_lines"]
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 40_000
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 120, 0.15, 4, 8, 40
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7

LOWER, UPPER, DIGIT, SPACE, NEWLINE, MARK, SYMBOL, OTHER = range(8)


def _classes() -> np.ndarray:
    """The class of each code point under 0x3000; those above are OTHER."""
    table = np.full(0x3000, OTHER, np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if c.isupper():
            table[code] = UPPER
        elif c.isalpha():
            table[code] = LOWER
        elif c.isdigit():
            table[code] = DIGIT
        elif c == "\n":
            table[code] = NEWLINE
        elif c.isspace():
            table[code] = SPACE
        elif c in ".,;:'\"()-?":
            table[code] = MARK
        elif code < 128:
            table[code] = SYMBOL
    return table


CLASSES = _classes()


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        counts = np.bincount(CLASSES[np.minimum(codes, 0x2FFF)], minlength=8)
        words = text.split()
        lines = text.split("\n")
        n, n_words = len(codes), max(len(words), 1)
        row[0] = np.log1p(n)
        row[1:8] = counts[1:] / n
        row[8] = min((n - counts[SPACE] - counts[NEWLINE]) / n_words, 50)
        row[9] = len(set(words)) / n_words
        row[10] = sum(len(w) > 15 for w in words) / n_words
        row[11] = len(set(lines)) / len(lines)
    return out


def _best_split(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    if len(g) < 2:
        return 0.0, 0
    gl, hl, gt, ht = g[:-1], h[:-1], g[-1], h[-1]
    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _line_tree(grad: np.ndarray, hess: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree that cuts one feature."""
    gain, k = _best_split(grad, hess)
    if depth == 0 or gain <= 1e-6:
        return np.full(len(grad), grad.sum() / (hess.sum() + 1))
    return np.concatenate([_line_tree(grad[:k], hess[:k], depth - 1), _line_tree(grad[k:], hess[k:], depth - 1)])


def _plane_tree(grad: np.ndarray, hess: np.ndarray, depth: int = 2) -> tuple[np.ndarray, float]:
    """Leaf values and gain of a tree over two features' bins."""
    leaf = grad.sum() / (hess.sum() + 1)
    options = [(*_best_split(grad.sum(1 - axis), hess.sum(1 - axis)), axis) for axis in (0, 1)]
    gain, k, axis = max(options)
    if depth == 0 or gain <= 1e-6:
        return np.full(grad.shape, leaf), 0.0
    parts = [_plane_tree(g, h, depth - 1) for g, h in zip(np.split(grad, [k], axis), np.split(hess, [k], axis), strict=True)]
    return np.concatenate([p[0] for p in parts], axis), gain + parts[0][1] + parts[1][1]


@dataclass
class AdditiveModel:
    """edges: inner bin borders by feature; tables by feature; pair tables with their features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    @property
    def learnt(self) -> bool:
        """Whether there was anything to fit on."""
        return bool(self.pairs)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
        total = np.full(len(x), self.intercept)
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[bins[i] * PAIR_BINS // BINS, bins[j] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    if not len(y):
        return AdditiveModel(0.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    intercept = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            grad, hess = slope()
            step = RATE * _line_tree(np.bincount(b, grad, len(tables[k])), np.bincount(b, hess, len(tables[k])))
            tables[k] += step
            total += step[b]
    coarse = [b * PAIR_BINS // BINS for b in bins]

    def planes(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        grad, hess = slope()
        cell = coarse[i] * PAIR_BINS + coarse[j]
        return tuple(np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (grad, hess))

    ranked = sorted(((-_plane_tree(*planes(i, j))[1], i, j) for i in range(len(bins)) for j in range(i)))[:PAIRS]
    pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            step = RATE * _plane_tree(*planes(i, j))[0]
            table += step
            total += step[coarse[i], coarse[j]]
    return AdditiveModel(intercept, edges, tables, pairs)


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every whole text, and whether the row is held out from fitting."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            x = features(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "held_out", "features"])

    rows = docs.select(common.long_id(), (common.fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), common.text_column().alias("text"))
    return rows.mapInArrow(task, "doc_id long, held_out boolean, features array<double>")


def training_labels(labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and quality of at most about train_rows labelled rows that are not held out, chosen by a hash of the id."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (common.fold_of("doc_id", FOLDS) != HELD_OUT)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = max(1, -(-marked.count() // train_rows))
    return common.materialize(marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), "labels")


def fit_on(table: DataFrame, chosen: DataFrame) -> AdditiveModel:
    """Fit on the rows of a feature table that have a training label."""
    rows = table.join(common.sized(chosen), "doc_id").select("doc_id", "features", "quality").distinct()
    rows = rows.orderBy(F.xxhash64("doc_id", "features", "quality"), "doc_id", "quality").limit(2 * TRAIN_ROWS).toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["quality"].to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1: the score is at least THRESHOLD)."""
    table = common.materialize(feature_table(docs), "quality")
    model = fit_on(table, training_labels(labels))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["features"].flatten().to_numpy().reshape(-1, len(FEATURES))
                s = model.scores(x)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose text is predicted to be good, with the columns they came with.

    The model is fitted first; its decision is then made beside each row, so no text is shuffled. With no labelled row to learn
    from, all documents stay.
    """
    chosen = training_labels(labels)
    ids = common.sized(chosen.select("doc_id").distinct())
    table = common.materialize(feature_table(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")), "quality")
    model = fit_on(table, chosen)
    if not model.learnt:
        return docs
    return common.keep_rows(docs, lambda texts: model.scores(features(texts)) >= THRESHOLD)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

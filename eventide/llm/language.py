"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector is the product of its letters'
vectors, rotated by their place; a text's vector is the sum of its trigrams' vectors, and a language's
prototype the sum of the vectors, brought to length 1, of its training texts. A text gets the language whose
prototype has the largest cosine with it. Vectors come from a fixed seed, and are the same everywhere.

Training uses all rows outside the held-out fold that have a language and a text with letters; the sums are made by Spark.
A row per language and dimension reaches the driver. A caller may ask for about so many rows of each language instead, chosen by a
hash of id and text; no query does.

The pipeline's stage keeps the texts that are in one of the asked languages (all that were learned, unless said otherwise) and
whose cosine is at least ``FLOOR`` of that which all but ``LOWEST`` of the training texts of about the same length reach, so texts
that are in none of the languages go.

Defined cases: a null text, or one without any letter, gets ``und`` and score 0; letters of any script
count, each with a vector of its own; texts of any length count whole; with nothing to learn from, every text gets ``und``, and
the stage keeps all texts that have a letter; ties go to the language that sorts first; repeated rows get equal results; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 512
LOWEST, FLOOR = 0.01, 0.5
#: Places to which cosines are rounded where a low one of them is taken, so that tasks count at most 10,001 values of each class.
PLACES = 4
FOLDS, HELD_OUT = 5, 0
#: Symbols up to here have a table: 0 between words, the letters a to z, and small letters of Latin scripts. Other letters' symbols are
#: their code points from here on, of up to so many bits.
SYMBOLS, BITS = 128, 21
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The symbol of each code point; upper and lower case share it."""
    latin = [c for c in map(chr, [*range(97, 123), *range(128, 384)]) if c.isalpha() and c.lower() == c][: SYMBOLS - 1]
    near = {ord(c): k + 1 for k, c in enumerate(latin)}
    table = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[code] = near.get(low, SYMBOLS + low)
    return table


def letter_vectors(symbols: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of +1 and -1 from the bits of hashes of the symbols."""
    x = symbols.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dimensions // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return 2 * np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) - 1


class Profiles:
    """Makes the vectors of trigrams, and of texts."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.letters = letter_vectors(np.arange(SYMBOLS), dimensions)
        self.column = np.zeros(SYMBOLS**3, np.int32)
        self.met = np.zeros(SYMBOLS**3, bool)

    def vectors(self, trigrams: np.ndarray) -> np.ndarray:
        """trigrams: rows of three symbols."""
        if not len(trigrams):
            return np.zeros((0, self.dimensions), np.float32)
        if trigrams.max() < SYMBOLS:
            a, b, c = (self.letters[x] for x in trigrams.T)
        else:
            which, place = np.unique(trigrams, return_inverse=True)
            letters = letter_vectors(which, self.dimensions)
            a, b, c = (letters[x] for x in place.reshape(trigrams.shape).T)
        return (np.roll(a, 2, 1) * np.roll(b, 1, 1) * c).astype(np.float32)

    def encode(self, texts: list[str], rows: int = 128, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """The vector of each text, zero for texts without letters, and its number of trigrams. So many texts and trigrams are handled at once."""
        out, sizes = np.zeros((len(texts), self.dimensions), np.float32), np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), rows):
            symbols = [self.symbols(text) for text in texts[at : at + rows]]
            near = all(s.max(initial=0) < SYMBOLS for s in symbols)
            part = [self.codes(s, SYMBOLS if near else 1 << BITS) for s in symbols]
            codes = np.concatenate(part)
            if near:
                self.met[codes] = True
                distinct = np.flatnonzero(self.met)
                self.met[distinct] = False
                self.column[distinct] = np.arange(len(distinct))
                column, base = self.column[codes], SYMBOLS
            else:
                distinct, column = np.unique(codes, return_inverse=True)
                base = 1 << BITS
            sizes[at : at + rows] = [len(x) for x in part]
            row = np.repeat(np.arange(len(part)), sizes[at : at + rows])
            for first in range(0, len(distinct), columns):
                width = min(columns, len(distinct) - first)
                here = (column >= first) & (column < first + width) if len(distinct) > columns else slice(None)
                counts = np.bincount(row[here] * width + column[here] - first, minlength=len(part) * width).reshape(len(part), width)
                some = distinct[first : first + width]
                out[at : at + rows] += counts.astype(np.float32) @ self.vectors(np.stack([some // base**2, some // base % base, some % base], 1))
        return out, sizes

    def symbols(self, text: str) -> np.ndarray:
        """The text's letters, with one 0 between words and at both ends."""
        s = _symbols()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")]
        return s[(s > 0) | (np.concatenate([[1], s[:-1]]) > 0)].astype(np.int64)

    def codes(self, s: np.ndarray, base: int) -> np.ndarray:
        """The trigrams whose middle is a letter."""
        return ((s[:-2] * base + s[1:-1]) * base + s[2:])[s[1:-1] > 0]


@lru_cache(maxsize=1)
def profiles() -> Profiles:
    """Those of this Python worker."""
    return Profiles()


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


@dataclass
class Model:
    """The languages, sorted, their prototypes as rows, and a low cosine of training texts by class of length."""

    langs: list[str]
    prototypes: np.ndarray
    floors: dict[int, float]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, the cosine (0 if negative) and the class of length of each text."""
        vectors, sizes = profiles().encode([x or "" for x in texts])
        classes = length_class(sizes)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), classes
        cosines = unit(vectors) @ self.prototypes.T
        best, found = cosines.argmax(1), sizes > 0
        return [self.langs[k] if y else UNKNOWN for k, y in zip(best, found, strict=True)], np.where(found, np.clip(cosines.max(1), 0, 1), 0.0), classes

    def keeps(self, texts: list[str | None], langs: frozenset[str] | None = None) -> list[bool]:
        found, cosines, classes = self.predict(texts)
        if not self.langs:
            return (classes > 0).tolist()
        return [x != UNKNOWN and (langs is None or x in langs) and y >= FLOOR * self.floors.get(c, 0.0) for x, y, c in zip(found, cosines.tolist(), classes.tolist(), strict=True)]


def length_class(sizes: np.ndarray) -> np.ndarray:
    """0 without trigrams, else the bits of their number, the same from 512 on."""
    return np.minimum(np.ceil(np.log2(sizes + 1)), 10).astype(int)


def chosen_rows(docs: DataFrame, per_language: int | None = None) -> DataFrame:
    """lang and text of the training rows: all, or about so many of each language."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.fold_of("doc_id", FOLDS) != HELD_OUT))
    if per_language is None:
        return usable.select("lang", "text")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    shares = docs.sparkSession.createDataFrame([(r["lang"], -(-r["n"] // per_language)) for r in counts], "lang string, share long")
    # as many rows as there are languages
    return usable.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.col("share")) == 0).select("lang", "text")


def train(docs: DataFrame, per_language: int | None = None, floors: bool = False) -> Model:
    """The model, if asked with low cosines of its training texts."""
    chosen = chosen_rows(docs, per_language)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches, 256):
            vectors, langs = unit(profiles().encode(batch["text"].to_pylist())[0]), np.array(batch["lang"].to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["lang", "vector"])

    sums = chosen.mapInArrow(summed, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("k", "x"))
    # A row per language and dimension. Rounding makes the sum the same in whichever order tasks end.
    rows = sums.groupBy("lang", "k").agg(F.round(F.sum(F.round("x", 6).cast("decimal(28,6)")), 6).cast("double").alias("x")).toPandas()
    if not len(rows):
        return Model([], np.zeros((0, DIMENSIONS)), {})
    wide = rows.pivot(index="lang", columns="k", values="x").sort_index()
    has_letters = np.abs(wide.to_numpy()).sum(1) > 0
    model = Model([x for x, y in zip(wide.index, has_letters, strict=True) if y], unit(wide.to_numpy()[has_letters]), {})
    if not floors:
        return model

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            _, cosines, classes = model.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(cosines)], names=["class", "cosine"])

    least = chosen.mapInArrow(lowest, "class int, cosine double").groupBy("class").agg(F.percentile(F.round("cosine", PLACES), LOWEST).alias("cosine")).collect()  # a row per class
    return replace(model, floors={r["class"]: r["cosine"] for r in least})


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = train(docs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            found, cosines, _ = model.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(found, pa.string()), pa.array(cosines)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(common.long_id(), (common.fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, langs: Iterable[str] | None = None) -> DataFrame:
    """The documents in one of these languages (None: any that was learned), with the columns they came with."""
    model, wanted = train(docs, floors=True), None if langs is None else frozenset(langs)
    return common.keep_rows(docs, lambda texts: model.keeps(texts, wanted))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.documents(spark, sf_dir))

"""Divergence of sources within each language, over K-squared quadtrees of the group-term count matrix.

A language's matrix has a row for each of its sources and a column for each term that enough of its documents hold. It
is cut into tiles: blocks of columns, by a hash of the term, and runs of rows. In a tile the columns are ordered by the number of
documents, so that rare terms leave large empty areas. A tile is held as a quadtree with two by two children: a bit for each quadrant
says whether it holds a count, an empty one has no node below, and the leaves are small squares of shares. Two tiles of the same columns are
traversed jointly for all pairs of their rows: where both quadrants are empty, all of their cells have the same share in a row, so
the number of columns times one term is their sum; everything else goes down to the leaves, which are compared cell by cell. Tiles
meet in tasks of a bounded size; sums of the blocks are added up by Spark.

All arithmetic is exact, in integers: the share of a count is p = 1 + floor(UNIT * (count + 1) / (N + V)), the divergence of p from q is
floor((p - q) * (p - q) / q).

Counts, totals and statistics are over all documents; each task adds up what it reads before rows are dealt by term.
The result has a row for every ordered pair of a language's sources, so its size grows with their number squared: that is what is asked for.

Defined cases: null text, lang and source are empty ones; a group without terms has only zero counts; a language without kept terms has
pairs of value 0 and no terms; a language with one source has no pairs; documents with equal ids are separate; repeated
rows count each time; ties are in the order of the items' UTF-8; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

UNIT, LEAST_DOCUMENTS, RANKS = 1_000_000_000, 3, 200
#: Rows and columns of a tile, and of a leaf; leaves that are compared at once; and distinct counts that a task holds before it passes them on.
TILE, BLOCK, LEAF, AT_ONCE, HELD = 128, 1024, 4, 512, 500_000
#: Bytes that terms consist of, A to Z lower-cased; all other bytes become blanks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    kind = "lang string, source string, term string, n long, docs long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in common.slices_by_size(batches, "text", 1 << 20):
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(docs)
                n.update(words := terms_of(text))
                docs.update(set(words))
                size += len(docs)
                if size > HELD:
                    yield from passed_on(held)
                    held, size = {}, 0
        yield from passed_on(held)

    def passed_on(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 20_000):
                some = terms[at : at + 20_000]
                columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    counted = docs.mapInArrow(task, kind)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kinds: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kinds)); decimals hold what a long might not."""
    big = lambda x: f"CAST({x} AS DECIMAL(20,0))"
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10,0)) * {big(f'{count} + 1')} DIV {big(f'{total} + {kinds}')}")


@dataclass
class QuadTree:
    """bits[k]: for each node of level k, whether its four quadrants hold a cell; nodes: the nodes before each bit; leaves: squares of shares.

    zero holds each row's share of a count of 0.
    """

    bits: list[np.ndarray]
    nodes: list[np.ndarray]
    leaves: np.ndarray
    zero: np.ndarray

    @staticmethod
    def build(row: np.ndarray, col: np.ndarray, value: np.ndarray, zero: np.ndarray, height: int) -> QuadTree:
        r, c = row // LEAF, col // LEAF
        code = np.zeros(len(r), np.int64)
        for k in range(height):
            code |= ((r >> k & 1) << (2 * k + 1)) | ((c >> k & 1) << (2 * k))
        now, at = np.unique(code, return_inverse=True)
        padded = np.ones(LEAF << height, np.int64)
        padded[: len(zero)] = zero
        own = np.zeros(len(now), np.int64)
        own[at] = r
        leaves = np.repeat(padded.reshape(-1, LEAF)[own][:, :, None], LEAF, 2)
        leaves[at, row % LEAF, col % LEAF] = value
        bits: list[np.ndarray] = []
        for _ in range(height):
            above, place = np.unique(now >> 2, return_inverse=True)
            of_level = np.zeros(4 * len(above), bool)
            of_level[4 * place + (now & 3)] = True
            bits.insert(0, of_level)
            now = above
        return QuadTree(bits, [np.cumsum(b) - 1 for b in bits], leaves, padded)

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The node of a quadrant of each node, -1 where that is empty, as it is in an empty node."""
        place = 4 * np.maximum(node, 0) + quadrant
        if not len(self.bits[level]):
            return np.full(len(node), -1)
        return np.where((node >= 0) & self.bits[level][place], self.nodes[level][place], -1)

    def shares(self, leaf: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The squares of these leaves; where there is none, the shares of zero counts in its rows."""
        empty = np.repeat(self.zero.reshape(-1, LEAF)[row][:, :, None], LEAF, 2)
        return np.where((leaf >= 0)[:, None, None], self.leaves[np.maximum(leaf, 0)], empty) if len(self.leaves) else empty


def divergences(a: QuadTree, b: QuadTree, rows: tuple[int, int], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The divergences of all rows of a from all rows of b, and of b from a (with a's rows first; left out if they are one), over so many columns."""
    height = len(a.bits)
    side, high, wide = 1 << height, -(-rows[0] // LEAF), -(-rows[1] // LEAF)
    empty = np.zeros((high, wide), np.int64)  # columns in which both rows have no count, by squares of rows
    some = lambda tree: np.zeros(1, np.int64) - (not len(tree.leaves))
    na, nb, ra, rb, c = some(a), some(b), *np.zeros((3, 1), np.int64)
    for level in range(height):
        parts, width, span = [], LEAF << (height - level - 1), side >> (level + 1)
        for i, j, k in np.ndindex(2, 2, 2):
            ca, cb = a.child(level, na, 2 * i + k), b.child(level, nb, 2 * j + k)
            qa, qb, qc = 2 * ra + i, 2 * rb + j, 2 * c + k
            inside = (qa * width < rows[0]) & (qb * width < rows[1]) & (qc * width < columns)
            both = inside & (ca < 0) & (cb < 0)
            for x, y, z in zip(qa[both], qb[both], qc[both], strict=True):
                empty[x * span : (x + 1) * span, y * span : (y + 1) * span] += min(width, columns - z * width)
            left = inside & ~both
            parts.append([x[left] for x in (ca, cb, qa, qb, qc)])
        na, nb, ra, rb, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not height:
        both = (na < 0) & (nb < 0)
        empty += columns * both
        na, nb, ra, rb, c = (x[~both] for x in (na, nb, ra, rb, c))
    order = np.lexsort((rb, ra))
    na, nb, ra, rb, c = (x[order] for x in (na, nb, ra, rb, c))
    # a tile with itself has all its pairs in one direction already
    sums = np.zeros((1 if a is b else 2, high, wide, LEAF, LEAF), np.int64)
    for at in range(0, len(c), AT_ONCE):
        x, y, where = ra[at : at + AT_ONCE], rb[at : at + AT_ONCE], c[at : at + AT_ONCE]
        p, q = a.shares(na[at : at + AT_ONCE], x)[:, :, None, :], b.shares(nb[at : at + AT_ONCE], y)[:, None, :, :]
        within = where[:, None] * LEAF + np.arange(LEAF) < columns
        firsts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        for k, by in enumerate((q, p)[: len(sums)]):
            found = quotients(p - q, by)
            if not within.all():
                found = found * within[:, None, None, :]
            np.add.at(sums[k], (x[firsts], y[firsts]), np.add.reduceat(found.sum(3), firsts).astype(np.int64))
    flat = sums.transpose(0, 1, 3, 2, 4).reshape(len(sums), high * LEAF, wide * LEAF)
    counts = np.repeat(np.repeat(empty, LEAF, 0), LEAF, 1)
    p, q = a.zero[: high * LEAF, None], b.zero[None, : wide * LEAF]
    return tuple((flat[k] + counts * ((p - q) ** 2 // by))[: rows[0], : rows[1]] for k, by in enumerate((q, p)[: len(sums)]))


def quotients(difference: np.ndarray, by: np.ndarray) -> np.ndarray:
    """floor(difference * difference / by). In doubles, which are fast, where they are exact: below 2 ** 53 a quotient of integers that is no
    integer is never rounded to one, and sums of the quotients of a chunk of leaves stay exact too."""
    if float(np.abs(difference).max(initial=0)) ** 2 * LEAF * AT_ONCE < 1 << 53:
        square = difference.astype(np.float64)
        square *= square
        square /= by
        return np.floor(square, out=square)
    return difference**2 // by


def pair_sums(cells: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """lang, one, other (rows of the matrix), value: a part of the divergence of one from the other, for each block.

    cells: lang, block, row, col, p, tiles; groups: lang, block, row, p (of a zero count), tiles, width (the block's columns).
    """
    own = F.expr(f"row DIV {tile}")
    met = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t")
    rows = groups.select("lang", "block", "row", F.lit(-1).alias("col"), "p", "width", own.alias("tile"), met)
    rows = rows.union(cells.select("lang", "block", "row", "col", "p", F.lit(0).alias("width"), own.alias("tile"), met))
    rows = rows.select("lang", "block", "row", "col", "p", "width", F.least("tile", "t").alias("a"), F.greatest("tile", "t").alias("b"))

    def task(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, a, b = (k.as_py() for k in key)
        row, col, p = (table[c].to_numpy() for c in ("row", "col", "p"))
        columns = int(table["width"].to_numpy().max())
        heads = col < 0
        sizes = {t: int((row[heads] // tile == t).sum()) for t in (a, b)}
        height = 0
        while LEAF << height < max(*sizes.values(), columns):
            height += 1
        trees = {}
        for t in {a, b}:
            of_tile = row // tile == t
            zero = np.zeros(sizes[t], np.int64)
            zero[row[heads & of_tile] - t * tile] = p[heads & of_tile]
            here = of_tile & ~heads
            trees[t] = QuadTree.build(row[here] - t * tile, col[here].astype(np.int64), p[here], zero, height)
        found = divergences(trees[a], trees[b], (sizes[a], sizes[b]), columns)
        one, other = (x.ravel() for x in np.meshgrid(np.arange(sizes[a]) + a * tile, np.arange(sizes[b]) + b * tile, indexing="ij"))
        value = found[0].ravel()
        if a == b:
            one, other, value = one[one != other], other[one != other], value[one != other]
        else:
            one, other, value = np.concatenate([one, other]), np.concatenate([other, one]), np.concatenate([value, found[1].ravel()])
        return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "one": one, "other": other, "value": value})

    return rows.groupBy("lang", "block", "a", "b").applyInArrow(task, "lang string, one long, other long, value long")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(empty("lang"), empty("source"), empty("text"))
    counts = common.materialize(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents)
    kept = common.materialize(kept, "kept")
    # Written, so that its size is known when the joins with it are planned: a join that is planned as a shuffle would deal terms by language.
    langs = common.materialize(kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("all")), "langs")
    placed = kept.join(langs, "lang").withColumn("block", F.expr(f"CAST(pmod(xxhash64(term), ceil(kinds / {block})) AS INT)"))
    in_block = Window.partitionBy("lang", "block").orderBy(F.desc("docs"), "term")
    terms = common.materialize(placed.withColumn("col", F.row_number().over(in_block) - 1), "terms")
    held = counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"])

    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    by_source = Window.partitionBy("lang").orderBy("source")
    every = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs.select("lang", "kinds"), "lang", "left")
    every = every.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("kinds", F.lit(0)).alias("kinds"), (F.row_number().over(by_source) - 1).cast("long").alias("row"), F.count("*").over(Window.partitionBy("lang")).alias("rows"))
    every = every.withColumn("tiles", F.ceil(F.col("rows") / tile).cast("int"))
    groups = common.materialize(every, "groups")

    cells = held.join(groups.select("lang", "source", "size", "row", "tiles"), ["lang", "source"])
    cells = cells.withColumn("p", share("n", "size", "kinds")).withColumn("q", share("total", "all", "kinds"))
    cells = common.materialize(cells.select("lang", "source", "term", "block", "row", "col", "p", "q", "tiles"), "cells")

    over = F.expr("((p - q) * (p - q)) DIV q")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value"))
    best = best.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)

    widths = terms.groupBy("lang", "block").agg(F.count("*").cast("int").alias("width"))
    blocks = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("kinds") / block), F.lit(1)).cast("int") - 1)).alias("block")
    zero = F.when(F.col("kinds") > 0, share("0", "size", "kinds")).otherwise(1).alias("p")
    heads = groups.select("lang", "row", zero, "tiles", blocks).join(widths, ["lang", "block"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    sums = pair_sums(cells, heads, tile).groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    named = lambda row, name: groups.select("lang", F.col("row").alias(row), F.col("source").alias(name))
    pairs = sums.join(named("one", "source"), ["lang", "one"]).join(named("other", "item"), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.union(best)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


def _oracle() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda count, total: f"CAST(1 + ({UNIT}::HUGEINT * ({count} + 1)) // ({total} + kinds) AS HUGEINT)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{letters}', '{letters.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS kinds, sum(total) AS every FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
h AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
m AS MATERIALIZED (SELECT lang, source, term, n, {p("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p, {p("total", "every")} AS q FROM h JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM m WHERE n > 0 AND p > q),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM w WHERE part = 'pair' OR rank <= {RANKS}"""


ORACLE = _oracle()

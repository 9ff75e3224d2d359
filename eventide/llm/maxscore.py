"""Exact top-k search by inner product with MaxScore over shards of postings.

The components of a vector, times ``SCALE`` and rounded down, are its terms: a dimension and a sign, with a weight. A shard
holds a posting list for each term, the vectors that have it and their weights, and the largest weight of each list. A query's terms
are those of its own signs; only they can add to a score, by at most the query's weight times the list's largest. Sorted by these bounds,
the terms whose bounds add up to less than the score to beat are non-essential: a vector in none of the other, essential,
lists cannot be among the best. The essential lists are traversed, partial scores added up, and of the vectors whose partial score and the
non-essential bounds still reach the score to beat, the remaining terms are probed, those of opposite signs first, in the order of
their bounds, as long as the vectors stay competitive. What is left has its exact score.

The score to beat grows as a shard's best are found. A first round searches one shard in ``SEED_EVERY``, by hash; the best k of these
give every query a score to beat for the second round, in which the other shards report only what reaches it, ties included. The best k of
all reports are the answer. Every candidate lies in one shard, every query is sent to all of them, in rows that are dealt by shard: neither queries nor
candidates are broadcast or collected. Work is, in the end, queries times candidates; the postings only make most of it cheap.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, neither as a query nor as a candidate;
vectors meet only those of their own length, and empty ones score 0; rows that share a vec_id are separate vectors, so a query has
the others among its candidates; a null vec_id asks nothing, and comes last among ties; fewer than k candidates give fewer rows; a query
without candidates gives none; components so large that sums could leave 53 bits are handled as unbounded integers, and a score beyond 64 bits
is given as the nearest that a long can hold; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE, TOP, QUERY_EVERY = 1024, 10, 100
#: Components of a shard, about, and the share of shards in the first round.
SHARD, SEED_EVERY = 1 << 19, 16
#: Terms that are probed at once, and queries that are handled between two Arrow batches.
PROBED, REPORTED = 8, 1024
LONGEST = (1 << 63) - 1
FOUND = "query long, rid long, vec_id long, score long"


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """SCALE times the components, rounded down: as doubles where sums of products are exact in them, else as Python's integers."""
    x = vectors.astype(np.float64)
    largest = np.abs(x).max(initial=0) * SCALE + 1
    if largest * largest * max(1, x.shape[1]) < 1 << 53:
        return np.floor(x * SCALE)
    out = np.empty(x.shape, object)
    for place, value in np.ndenumerate(x):
        top, bottom = float(value).as_integer_ratio()
        out[place] = top * SCALE // bottom
    return out


@dataclass
class Postings:
    """A shard: its vectors as rows, and for each dimension and sign the rows that have it, their weights, and the largest weight."""

    rid: np.ndarray
    vec_id: pa.Array
    rows: np.ndarray
    lists: list[tuple[list[np.ndarray], list[np.ndarray]]]
    peaks: np.ndarray

    @staticmethod
    def build(rid: np.ndarray, vec_id: pa.Array, rows: np.ndarray) -> Postings:
        lists, peaks = [], np.zeros((2, rows.shape[1]), rows.dtype)
        for k, sign in enumerate((1, -1)):
            of_sign: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
            for d in range(rows.shape[1]):
                column = rows[:, d] * sign
                held = np.flatnonzero(column > 0)
                of_sign[0].append(held)
                of_sign[1].append(column[held])
                peaks[k, d] = max(of_sign[1][-1], default=0) if rows.dtype == object else of_sign[1][-1].max(initial=0)
            lists.append(of_sign)
        return Postings(rid, vec_id, rows, lists, peaks)

    def best(self, query: np.ndarray, rid: int, beat: float | int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the best k, in any order, of those not below the score to beat (None: all); ties to the smaller vec_id."""
        beat = self.to_beat(beat)
        weights, signs = np.abs(query), (query < 0).astype(int)
        bounds = weights * self.peaks[signs, np.arange(len(query))]
        order = np.argsort(-bounds, kind="stable")
        #: what the terms from a place in this order on can add at most
        tails = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])
        if beat is None:
            essential = len(order)
        elif tails[0] < beat:
            return np.zeros(0, int), tails[:0]
        else:
            essential = min(len(order), int((tails >= beat).sum()))
        partial = np.zeros(len(self.rows), self.rows.dtype)
        for d in order[:essential]:
            held, values = self.lists[signs[d]][0][d], self.lists[signs[d]][1][d]
            if weights[d] and len(held):
                partial[held] += weights[d] * values
        rest = tails[essential]
        near = np.flatnonzero(self.rid != rid)
        if beat is not None:
            near = near[partial[near] + rest >= beat]
        if len(near) > 4 * k:  # the exact scores of the best so far raise the score to beat
            first = near[np.argsort(-partial[near], kind="stable")[: 2 * k]] if self.rows.dtype == object else near[np.argpartition(partial[near], len(near) - 2 * k)[-2 * k :]]
            reached = self.to_beat(np.sort(self.rows[first] @ query)[-k])
            beat = reached if beat is None or reached is not None and reached > beat else beat
            near = near if beat is None else near[partial[near] + rest >= beat]
        # The opposite signs of essential terms only take away; then the other terms add or take away.
        score = self.rows[np.ix_(near, order[:essential])] @ query[order[:essential]] if essential else partial[near]
        for at in range(essential, len(order) + PROBED, PROBED):
            if beat is not None:
                left = score + tails[min(at, len(order))] >= beat
                near, score = near[left], score[left]
            if at < len(order):
                probed = order[at : at + PROBED]
                score = score + self.rows[np.ix_(near, probed)] @ query[probed]
        if score.dtype == object:
            score = np.array([max(-LONGEST - 1, min(LONGEST, int(s))) for s in score], object)
        if len(near) > k:
            kth = np.sort(score)[-k]
            above, level = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
            tied = self.vec_id.take(pa.array(near[level]))
            first = np.lexsort((tied.fill_null(0).to_numpy(), tied.is_null().to_numpy(zero_copy_only=False)))
            left = np.concatenate([above, level[first[: k - len(above)]]])
            near, score = near[left], score[left]
        return near, score

    @staticmethod
    def to_beat(score: float | int | None) -> float | int | None:
        """The score, if a long can tell those below it from it."""
        return None if score is None or score <= -LONGEST - 1 else min(score, LONGEST)

    def in_integers(self) -> Postings:
        return Postings.build(self.rid, self.vec_id, as_integers(self.rows))


def search(rows: DataFrame, k: int) -> DataFrame:
    """The best of each shard for each query. rows: dim, shard, asks, rid, vec_id, beat, vector.

    A shard's candidates come before its queries, which stream past the postings.
    """

    names = ["dim", "shard", "asks"]

    def vectors(part: pa.RecordBatch, dim: int) -> np.ndarray:
        return whole_numbers(part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, postings = None, [], None
        for (dim, shard, asks), part in (stretch for batch in batches for stretch in stretches(batch, names)):
            if (dim, shard) != at:
                at, held, postings = (dim, shard), [], None
            if not asks:
                held.append(part)
                continue
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                postings, held = Postings.build(whole["rid"].to_numpy(), whole["vec_id"], vectors(whole, dim)), []
            if postings is None:  # a shard without candidates
                continue
            queries = vectors(part, dim)
            if not exact_together(postings.rows, queries):
                queries = as_integers(queries)
                if postings.rows.dtype != object:
                    postings = postings.in_integers()
            found: list[tuple] = []
            for query, own, beat in zip(queries, part["rid"].to_pylist(), part["beat"].to_pylist(), strict=True):
                near, score = postings.best(query, own, beat, k)
                found += [(own, int(postings.rid[i]), postings.vec_id[i].as_py(), int(s)) for i, s in zip(near.tolist(), score.tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query", "rid", "vec_id", "score"])

    return rows.repartition("dim", "shard").sortWithinPartitions(*names).mapInArrow(task, FOUND)


def stretches(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Key and rows of each run of equal keys in the batch, of ``REPORTED`` rows at most."""
    values = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in keys], 1)
    bounds = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), batch.num_rows]
    for low, high in zip(bounds, bounds[1:], strict=False):
        for at in range(low, high, REPORTED):
            yield tuple(values[at].tolist()), batch.slice(at, min(REPORTED, high - at))


def as_integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def exact_together(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sums of the products are exact in doubles, or both are Python's integers already."""
    if a.dtype == object or b.dtype == object:
        return a.dtype == b.dtype
    return np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 1 << 53


def usable(column: str) -> F.Column:
    """Whether a vector takes part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~bad


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, queries: F.Column, k: int = TOP, shard: int = SHARD, seed_every: int = SEED_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all other rows for each row of vec_id, embedding that the condition names."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asking"))
    rows = common.materialize(rows.where(usable("vector")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    total = rows.agg(F.sum(F.size("vector").cast("long")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard))
    place = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    held = rows.select(F.size("vector").alias("dim"), place.alias("shard"), F.lit(False).alias("asks"), "rid", "vec_id", F.lit(None).cast("long").alias("beat"), "vector")
    asking = rows.where("asking").select(F.size("vector").alias("dim"), F.lit(True).alias("asks"), "rid", F.lit(None).cast("long").alias("vec_id"), "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(seed_every)))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s % seed_every != 0))
    of_seeds = F.col("shard") % seed_every == 0
    first = asking.withColumn("shard", every).withColumn("beat", F.lit(None).cast("long"))
    seeds = common.materialize(best_of(search(held.where(of_seeds).unionByName(first), k), k), "seeds")
    found = seeds.drop("rank")
    if shards > 1:
        beats = seeds.where(F.col("rank") == k).select("query", F.col("score").alias("beat"))
        second = asking.join(beats, asking["rid"] == beats["query"], "left").drop("query").withColumn("shard", others)
        found = found.union(search(held.where(~of_seeds).unionByName(second), k))
    names = rows.where("asking").select(F.col("rid").alias("query"), F.col("vec_id").alias("query_id"))
    return best_of(found, k).join(names, "query").select("query_id", "rank", "vec_id", "score")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, CAST(CASE WHEN len(q.e) <> len(c.e) THEN NULL WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_EVERY} = 0),
k AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= {TOP}"""

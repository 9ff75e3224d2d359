"""Embedding near-dedup over an inverted multi-index.

Each half of a vector has a codebook of its own; their product is a grid of cells, and each vector lies
in the cell of its halves' nearest codewords. A vector visits cells in the order of its distance to
them (the multi-sequence algorithm: a heap over the two sorted lists of half distances) until the
distance exceeds that of its own cell by a slack. The slack is set so that the target recall is reached:
query vectors are compared with all vectors, and each true link says with which slack it is found. Each query
counts the same, however many links it has, and the target is to be reached in every class of queries (by the number of
their links, in powers of two) and band of the cosine, so no large group speaks for the others. Blocks of queries are added
until ``ENOUGH`` of them have links but lie in no group of over a hundredth of the vectors; if ``MOST_QUERIES`` do
not give so many, the slack also has to find made pairs, sampled vectors turned to the threshold in random directions.
Only histograms of slacks are gathered. What is met in a visited cell is verified by the cosine in double precision.

A cell's members and its visitors are cut into blocks, and two blocks at a time meet in a task, which
returns counts and a spanning forest, not pairs. A link that both of its vectors find counts once: a visitor
counts its own finds, and the member's side is counted only if the member does not visit the visitor's cell.

Codebooks come from a sample of vectors chosen by a hash, about ``SAMPLE`` or ``PER_WORD`` for each codeword, twice as many at
most; every vector is indexed. Cells hold about ``PER_CELL`` vectors up to the grid of ``MOST_WORDS`` words a half (268 million
vectors); beyond, they grow with the table. N different vectors that are all alike are N * N / 2 links, each of which is verified,
and each of them is sent to about N / ``MEMBERS`` tasks.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing and keeps
its own id; equal vectors are linked with each other and handled as one; vectors of different lengths do not link;
vectors of one component link if their signs agree; a cosine of just the threshold links; an empty table gives an empty result;
rows that share a vec_id are separate vectors; a null vec_id is the smallest of its group only if there is no
other; labels and other columns are not looked at. Vectors are told apart by xxHash64.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

THRESHOLD, RECALL = 0.95, 0.99
SAMPLE, PER_WORD, QUERIES, PER_CELL, MOST_WORDS = 20_000, 32, 400, 64, 2048
#: Queries with links outside large groups after which no more are asked, queries at most, and bands of the cosine from the threshold to 1.
ENOUGH, MOST_QUERIES, BANDS = 100, 6400, 5
MEMBERS, VISITORS = 1024, 2048
BINS, WIDEST = 4000, 4.0
#: Vectors that the driver compares with all codewords at once.
SLICE = 2048


@dataclass
class MultiIndex:
    """Codebooks of the two halves, and the slack of the traversal."""

    first: np.ndarray
    second: np.ndarray
    slack: float = 0.0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of unit vectors' halves to the codewords."""
        half = self.first.shape[1]
        return _squares(x[:, :half], self.first), _squares(x[:, half:], self.second)

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> list[tuple[int, int]]:
        """The cells of a vector with these half distances, nearest first, as far as the slack allows."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        limit = s1[0] + s2[0] + self.slack
        heap, found = [(s1[0] + s2[0], 0, 0)], []
        while heap:
            total, i, j = heapq.heappop(heap)
            if total > limit:
                break
            found.append((int(o1[i]), int(o2[j])))
            if j + 1 < len(s2):
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(s1):
                heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        return found


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1), 0)


def codebook(x: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """Codewords by Lloyd's algorithm."""
    words = x[np.random.default_rng(3).permutation(len(x))[:size]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_squares(x[at : at + SLICE], words).argmin(1) for at in range(0, len(x), SLICE)])
        counts = np.bincount(nearest, minlength=len(words))
        sums = np.stack([np.bincount(nearest, column, len(words)) for column in x.T], 1)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def unit(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    """The batch's vectors, of one length, brought to length 1 in double precision."""
    values = batch[column]
    x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def usable(column: str):
    """Whether a vector has a direction."""
    finite = F.forall(column, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda v: v != 0), F.lit(False))


def build(distinct: DataFrame, total: int, threshold: float, recall: float) -> MultiIndex:
    """Codebooks from a sample, and the slack that reaches the recall for queries against all vectors."""
    size = int(np.clip(np.sqrt(total / PER_CELL), 1, MOST_WORDS))
    sample = max(SAMPLE, PER_WORD * size)
    share = max(1, -(-total // sample))
    rows = distinct.where(F.pmod(F.xxhash64("nid"), F.lit(share)) == 0).orderBy("nid").limit(2 * sample).select("vector").toArrow().combine_chunks()
    x = unit(rows.to_batches()[0]) if rows.num_rows else np.zeros((0, 1))
    if not len(x):
        x = unit(distinct.limit(1000).select("vector").toArrow().combine_chunks().to_batches()[0])
    half = x.shape[1] // 2
    index = MultiIndex(codebook(x[:, :half], size), codebook(x[:, half:], size))
    order, asked = np.random.default_rng(4).permutation(len(x))[:MOST_QUERIES], 0
    needed: dict[tuple[int, int], np.ndarray] = {}
    few = True
    while few and asked < len(order):
        block = order[asked : max(QUERIES, 2 * asked)]
        for row in needed_slacks(distinct, index, x[block], threshold).collect():  # at most BINS rows for each class and band
            needed.setdefault((row["class"], row["band"]), np.zeros(BINS))[row["bin"]] += row["queries"]
        asked += len(block)
        outside: dict[int, float] = {}  # queries by class, in the band that has the most
        for (of_class, _), held in needed.items():
            if 2**of_class <= max(1, total / 100):
                outside[of_class] = max(outside.get(of_class, 0), held.sum())
        few = sum(outside.values()) < ENOUGH - 1e-6
    reached = [float((np.cumsum(held) >= recall * held.sum() - 1e-9).argmax() + 1) * WIDEST / BINS for held in needed.values()]
    if few:
        reached.append(made_slack(index, x[order], threshold, recall))
    index.slack = max(reached)
    return index


def slack_between(index: MultiIndex, near: tuple[np.ndarray, np.ndarray], far: tuple[np.ndarray, np.ndarray], q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The least slack with which one of vectors q and k visits the other's cell; near and far: their half distances."""
    (a1, a2), (d1, d2) = near, far
    from_query = a1[q, d1.argmin(1)[k]] + a2[q, d2.argmin(1)[k]] - (a1.min(1) + a2.min(1))[q]
    from_other = d1[k, a1.argmin(1)[q]] + d2[k, a2.argmin(1)[q]] - (d1.min(1) + d2.min(1))[k]
    return np.minimum(from_query, from_other)


def needed_slacks(distinct: DataFrame, index: MultiIndex, asked: np.ndarray, threshold: float) -> DataFrame:
    """class (of a query's number of links, a power of two), band, bin (of the slack), queries: each query with links in a band adds 1 to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = index.distances(asked)
        for batch in common.slices(batches, max(64, 4096 * QUERIES // len(asked))):
            y = unit(batch)
            cosines = asked @ y.T
            q, k = np.nonzero((cosines >= threshold) & (cosines < 1 - 1e-12))
            slack = slack_between(index, near, index.distances(y), q, k)
            band = np.minimum((cosines[q, k] - threshold) / (1 - threshold) * BANDS, BANDS - 1).astype(int)
            found, n = np.unique((q * BANDS + band) * BINS + np.minimum((slack / WIDEST * BINS).astype(int), BINS - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (found // BINS // BANDS, found // BINS % BANDS, found % BINS, n)], names=["query", "band", "bin", "n"])

    links = distinct.select("vector").mapInArrow(task, "query long, band long, bin long, n long").groupBy("query", "band", "bin").agg(F.sum("n").alias("n"))
    of_query, of_band = F.sum("n").over(Window.partitionBy("query")), F.sum("n").over(Window.partitionBy("query", "band"))
    return links.select(F.floor(F.log2(of_query)).cast("int").alias("class"), "band", "bin", (F.col("n") / of_band).alias("share")).groupBy("class", "band", "bin").agg(F.sum("share").alias("queries"))


def made_slack(index: MultiIndex, x: np.ndarray, threshold: float, recall: float) -> float:
    """The slack that finds this share of pairs of a vector and one at the threshold from it in a random direction."""
    turned = np.random.default_rng(5).normal(size=x.shape)
    turned -= (turned * x).sum(1, keepdims=True) * x
    turned /= np.maximum(np.sqrt((turned**2).sum(1, keepdims=True)), 1e-12)
    like = threshold * x + np.sqrt(1 - threshold**2) * turned
    pairs = [(x[at : at + SLICE], like[at : at + SLICE]) for at in range(0, len(x), SLICE)]
    slack = np.concatenate([slack_between(index, index.distances(a), index.distances(b), np.arange(len(a)), np.arange(len(a))) for a, b in pairs])
    return float(np.quantile(slack, recall, method="higher")) + WIDEST / BINS


def placed(distinct: DataFrame, index: MultiIndex) -> DataFrame:
    """A row for each vector and cell that it visits: cell, member (it lies there), nid, copies, vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1024):
            d1, d2 = index.distances(unit(batch))
            cells, owner, member = [], [], []
            for k in range(batch.num_rows):
                seen = index.visits(d1[k], d2[k])
                cells += [i * len(index.second) + j for i, j in seen]
                owner += [k] * len(seen)
                member += [True] + [False] * (len(seen) - 1)
            rows = batch.take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(member), rows["nid"], rows["copies"], rows["vector"]], names=["cell", "member", "nid", "copies", "vector"])

    kind = distinct.schema["vector"].dataType.simpleString()
    return distinct.mapInArrow(task, f"cell long, member boolean, nid long, copies long, vector {kind}")


def met(groups: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    """groups: cell, block, turn, role (true: member), nid, copies, vector. Gives nid, links, leader."""
    width = len(index.second)

    def links(cell: int, role: np.ndarray, nid: np.ndarray, copies: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        members, visitors = np.flatnonzero(role), np.flatnonzero(~role)
        if not len(members) or not len(visitors):
            return []
        y, x = x[members], x[visitors]
        like = x @ y.T >= threshold
        like &= nid[visitors][:, None] != nid[members][None, :]
        if not like.any():
            return []
        x1, x2 = index.distances(x)
        y1, y2 = index.distances(y)
        limit = y1.min(1) + y2.min(1) + index.slack
        back = y1[:, x1.argmin(1)].T + y2[:, x2.argmin(1)].T <= limit[None, :]  # the member visits the visitor's cell
        n_x, n_y = like @ copies[members], copies[visitors] @ (like & ~back)
        label = np.concatenate([np.arange(len(x)), len(x) + np.arange(len(y))])
        ids = np.concatenate([nid[visitors], nid[members]])
        while True:  # the smallest label spreads over the links
            lx, ly = label[: len(x)], label[len(x) :]
            lx = np.minimum(lx, np.where(like, ly[None, :], len(label)).min(1))
            ly = np.minimum(ly, np.where(like, lx[:, None], len(label)).min(0))
            new = np.concatenate([lx, ly])
            if (new == label).all():
                break
            label = new
        linked = np.concatenate([like.any(1), like.any(0)])
        return [ids[linked], np.concatenate([n_x, n_y])[linked], ids[label[linked]]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, _, _), whole in common.groups(batches, names):
            found = links(cell, *[whole[c].to_numpy(zero_copy_only=False) for c in ("role", "nid", "copies")], unit(whole))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["nid", "links", "leader"])

    names = ["cell", "block", "turn"]
    return groups.repartition(*names).sortWithinPartitions(*names).mapInArrow(task, "nid long, links long, leader long")


def found_links(distinct: DataFrame, threshold: float, recall: float, members: int, visitors: int) -> DataFrame:
    """nid, links, leader, for vectors of one length."""
    total = distinct.count()
    index = build(distinct, total, threshold, recall)
    rows = common.materialize(placed(distinct, index), "cells")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count_if("member") / members).cast("int").alias("blocks"), F.ceil(F.count("*") / visitors).cast("int").alias("turns"))
    sized = rows.join(sizes.where("blocks > 0"), "cell")
    hashed = lambda most: F.pmod(F.xxhash64("nid"), F.col(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    held = sized.where("member").select("cell", hashed("blocks").alias("block"), every("turns").alias("turn"), F.lit(True).alias("role"), "nid", "copies", "vector")
    asking = sized.select("cell", every("blocks").alias("block"), hashed("turns").alias("turn"), F.lit(False).alias("role"), "nid", "copies", "vector")
    return met(held.union(asking), index, threshold)


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, members: int = MEMBERS, visitors: int = VISITORS) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    kind = table.schema["embedding"].dataType
    direction = F.when(F.size("embedding") == 1, F.transform("embedding", F.signum).cast(kind)).otherwise(F.col("embedding"))
    rows = table.select("vec_id", F.when(usable("embedding"), direction).alias("vector"))
    rows = rows.withColumn("nid", F.xxhash64("vector", F.size("vector")))
    distinct = common.materialize(rows.where("vector IS NOT NULL").groupBy("nid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "distinct")
    links = None
    for row in distinct.select(F.size("vector").alias("n")).distinct().collect():  # the lengths of vectors, of which there are few
        found = found_links(distinct.where(F.size("vector") == row["n"]), threshold, recall, members, visitors) if row["n"] > 1 else None
        links = found if links is None else links.union(found) if found is not None else links
    spark = table.sparkSession
    links = spark.createDataFrame([], "nid long, links long, leader long") if links is None else common.materialize(links, "links")
    groups = connected_components(links.select(F.col("nid").alias("u"), F.col("leader").alias("v"))).withColumnRenamed("id", "nid")
    counted = links.groupBy("nid").agg(F.sum("links").alias("links"))
    known = distinct.select("nid", "rep", "copies").join(counted, "nid", "left").join(groups, "nid", "left")
    known = known.withColumn("component", F.coalesce("component", "nid"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = known.join(least, "component").select("nid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.when(F.col("vector").isNotNull(), F.col("nid")).alias("nid")).join(final, "nid", "left")
    component = F.when(F.col("nid").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS MATERIALIZED (SELECT r, vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= {THRESHOLD}),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
m AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN v ON r = y GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m ON m.x = v.r LEFT JOIN n ON n.x = v.r"""

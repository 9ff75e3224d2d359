"""N-gram Jaccard join by MinHash banding.

1. Texts that are equal are one class, so copies are handled once, however many there are.
2. Each text's n-grams of words give a MinHash signature, cut into bands. The number of rows of a band is
   the largest for which at most ``MAX_HASHES`` hashes reach the target recall at the threshold.
3. The classes that share a band hash are a bucket, and its smallest class leads it. All classes of the buckets
   with one leader are a group, so every candidate pair is in a group, and a class is in at most as many groups as
   there are bands. A pair that is in several groups is compared in that of the smallest leader only, and a group all
   of whose members have one smaller leader in common is left out.
4. The sets of n-gram hashes of a group's members meet in a task, which counts the common n-grams of all its
   pairs at once and keeps the pairs whose Jaccard similarity of the full n-gram sets reaches the threshold. Groups of
   over ``BLOCK`` members or ``BLOCK_GRAMS`` n-grams are cut into blocks, two of which meet at a time. A task returns
   counts and a spanning forest, not the pairs.
5. The forests' components are the groups of near copies.

Cost: the pairs compared are those of classes that share a leader, so texts that form a long chain of weak likenesses
cost in proportion to their number. N different texts that are all alike are N * N / 2 links, each of which is compared (their
numbers are part of the result); each of these texts is sent to about N / ``BLOCK`` tasks.

Words are runs of letters, digits and characters beyond ASCII, lower-cased. A text with fewer than n words has one
n-gram, all its words.

Defined cases: null and empty texts, and those without words, link with nothing, not even each other;
equal texts link with each other; rows that share a doc_id, or are wholly equal, are separate rows, which link like any
others; a null doc_id is never the smallest of its group, unless there is no other; texts of any length are compared
whole; other columns are not looked at; an empty table gives an empty result. Texts are told apart by 64 bits of
xxHash64 and the CRC-32, n-grams by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

WORDS, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 128
#: Classes of a block and their n-grams, about; two blocks meet in a task.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest candidates, that reach the recall at the threshold."""
    for rows in range(most, 0, -1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-chance)))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def ngrams(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the text's n-grams in their order, with repeats."""
    tokens = text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    hashed = pd.util.hash_array(np.array(tokens, dtype=object), categorize=False)
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashed[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return out


class Signer:
    """Band hashes of texts."""

    def __init__(self, words: int, bands: int, rows: int) -> None:
        rng = np.random.default_rng(5)
        self.words, self.bands, self.rows = words, bands, rows
        n = bands * rows
        self.factor = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.half = n // 2

    def signature(self, grams: np.ndarray) -> np.ndarray:
        low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        for x, part in ((low, slice(0, self.half)), (high, slice(self.half, None))):
            for at in range(0, len(x), 2048):
                h = x[at : at + 2048, None] * self.factor[part] + self.shift[part]
                np.minimum(out[part], h.min(0), out=out[part])
        return out

    def band_hashes(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Each text's bands, none if it has no words, and its number of n-grams."""
        out, sizes = [], []
        for text in texts:
            grams = ngrams(text, self.words)
            sizes.append(len(grams))
            if not len(grams):
                out.append(np.zeros(0, np.int64))
                continue
            rows = self.signature(grams).reshape(self.bands, self.rows).astype(np.uint64)
            h = np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD
            for k in range(self.rows):
                h = (h ^ rows[:, k]) * _ODD
                h ^= h >> np.uint64(32)
            out.append(h.view(np.int64))
        return out, sizes


def text_keys() -> list[Column]:
    """What tells texts apart."""
    text = common.text_column()
    return [F.xxhash64(text).alias("cid"), F.crc32(text.cast("binary")).alias("sum32")]


def sign(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, cid and sum32 (which tell texts apart), the number of n-grams, bands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(words, bands, rows)
        for batch in common.slices(batches, 512):
            hashes, sizes = signer.band_hashes(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["cid"], batch["sum32"], pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "cid", "sum32", "grams", "bands"])

    keyed = docs.select(common.long_id(), *text_keys(), common.text_column().alias("text"))
    return keyed.mapInArrow(task, "doc_id long, cid long, sum32 long, grams long, bands array<long>")


def candidate_groups(classes: DataFrame, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """For each class that shares a bucket and has something to compare: id, its leaders in ascending order, and the groups
    it is in, each with its leader, number of members and number of blocks."""
    banded = classes.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("held"), F.min("id").alias("leader")).where("held > 1").select("band", "leader")
    led = banded.join(shared, "band").groupBy("id").agg(F.sort_array(F.collect_set("leader")).alias("leaders"))
    led = common.materialize(led.join(classes.select("id", "grams"), "id"), "led")  # at most a leader for each band
    of_leader = led.select("id", "grams", F.element_at("leaders", 1).alias("first"), F.explode("leaders").alias("leader"))
    sizes = of_leader.groupBy("leader").agg(F.count("*").alias("members"), F.sum("grams").alias("grams"), F.min("first").alias("low"), F.max("first").alias("high"))
    blocks = F.ceil(F.greatest(F.col("members") / block, F.col("grams") / block_grams)).cast("int")
    kept = sizes.where("low <> high OR low = leader").select("leader", "members", blocks.alias("blocks"))
    placed = of_leader.select("id", "leader").join(kept, "leader").groupBy("id").agg(F.collect_list(F.struct("leader", "members", "blocks")).alias("groups"))
    return led.select("id", "leaders").join(placed, "id")


def common_grams(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many n-grams each two of the sets share."""
    n = len(sets)
    which, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    kept = np.flatnonzero(counts > 1)  # a gram of one set is common to none
    column = np.full(len(which), -1)
    column[kept] = np.arange(len(kept))
    place = column[inverse]
    out = np.zeros((n, n), np.float32)
    for first in range(0, len(kept), columns):
        here = (place >= first) & (place < first + columns)
        held = np.zeros((n, min(columns, len(kept) - first)), np.float32)
        held[owner[here], place[here] - first] = 1
        out += held @ held.T
    return out


def roots_of(like: np.ndarray) -> np.ndarray:
    """The smallest index of each index's group, where this symmetric matrix says which two belong together."""
    label = np.arange(len(like))
    while True:
        new = np.minimum(label, np.where(like, label[None, :], len(like)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def gram_sets(texts: DataFrame, words: int) -> DataFrame:
    """The rows with the distinct hashes of the text's n-grams in place of the column text."""
    kept = [c for c in texts.columns if c != "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            sets = [np.unique(ngrams(x, words)).view(np.int64) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(sets, pa.list_(pa.int64()))], names=[*kept, "grams"])

    fields = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept]
    return texts.mapInArrow(task, ", ".join([*fields, "grams array<long>"]))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: leader, left, right (two blocks of a group), block, id, copies, leaders, grams. Gives id, links, root for classes with links."""
    keys = ["leader", "left", "right"]

    def links(leader: int, group: pa.RecordBatch) -> list[np.ndarray] | None:
        ids, copies, blocks = (group[c].to_numpy() for c in ("id", "copies", "block"))
        pairs = ~np.eye(len(ids), dtype=bool)
        if blocks.min() != blocks.max():
            pairs &= blocks[:, None] != blocks[None, :]  # the pairs within a block meet in a group of their own
        earlier = [x[x < leader] for x in _lists(group["leaders"])]
        if any(map(len, earlier)):
            pairs &= common_grams(earlier) == 0  # the others meet under a smaller leader
        if not pairs.any():
            return None
        sets = _lists(group["grams"])
        sizes = np.array([len(x) for x in sets])
        both = common_grams(sets)
        like = pairs & (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6)
        found = like @ copies
        root = ids[roots_of(like)]
        linked = np.flatnonzero(found)
        return [ids[linked], found[linked], root[linked]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leader, _, _), group in common.groups(batches, keys):
            if group.num_rows > 1 and (found := links(leader, group)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["id", "links", "root"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, "id long, links long, root long")


def join_similar(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_links (other documents that it is similar to), component_id (smallest doc_id of its group), kept."""
    return verdicts(docs, **options).select("doc_id", "n_links", "component_id", "kept")


def classes_of(signed: DataFrame) -> DataFrame:
    """The distinct texts with words: id (a number of its own each), cid, sum32, rep (smallest doc_id), copies, grams, bands."""
    held = signed.where("grams > 0").groupBy("cid", "sum32").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    return common.materialize(held.withColumn("id", F.monotonically_increasing_id()), "classes")


def verdicts(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """What join_similar gives, with the keys of the text, cid and sum32, and a number of its group (null: the text has no words)."""
    bands, rows = plan_bands(threshold, recall)
    signed = common.materialize(sign(docs, words, bands, rows), "signed")
    classes = classes_of(signed)
    members = common.materialize(candidate_groups(classes, block).join(classes.select("id", "cid", "sum32", "copies"), "id"), "members")

    text = common.text_column()
    texts = common.marked(docs.select(*text_keys(), text.alias("text")), members, ["cid", "sum32"], "may").where("may")
    texts = texts.groupBy("cid", "sum32").agg(F.first("text").alias("text"))  # one of the copies
    sets = gram_sets(texts.join(members, ["cid", "sum32"]).select("id", "copies", "leaders", "groups", "text"), words)
    grouped = sets.select("id", "copies", "leaders", "grams", F.explode("groups").alias("g")).select("*", "g.leader", "g.blocks").drop("g")
    grouped = grouped.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = grouped.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("leader", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "id", "copies", "leaders", "grams")
    links = common.materialize(verified(paired, threshold), "links")

    near = connected_components(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.drop("bands", "grams").join(counted, "id", "left").join(near, "id", "left")
    known = known.select("cid", "sum32", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("group"))
    final = known.join(known.groupBy("group").agg(F.min("rep").alias("component_id")), "group").drop("rep")
    out = signed.select("doc_id", "cid", "sum32", (F.col("grams") > 0).alias("has_words")).join(final, ["cid", "sum32"], "left")
    component = F.when(F.col("has_words"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "cid", "sum32", "group", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near copies, with the columns it came with: that of the smallest doc_id, and if several
    rows of the group have it, the one whose columns come first as JSON. Documents without words all stay.

    The rows that may have to go are found by a bitmap, so only they are shuffled.
    """
    found = common.materialize(verdicts(docs, **options), "verdicts")
    kept = found.where("kept AND group IS NOT NULL")
    twice = common.materialize(kept.groupBy("group").agg(F.count("*").alias("rows")).where("rows > 1").select("group"), "twice")
    names = ["doc_id", "cid", "sum32"]
    gone = found.where("NOT kept").select(*names, F.lit(None).cast("long").alias("group"))
    several = not twice.isEmpty()
    if several:
        gone = gone.union(kept.join(twice, "group").select(*names, "group")).distinct()
    gone = common.materialize(gone, "gone")

    columns = [F.col(c) for c in docs.columns]
    mine = {n: common.free_name(docs.columns, f"_key_{n}") for n in names}
    keyed = docs.withColumns(dict(zip(mine.values(), [F.col("doc_id"), *text_keys()], strict=True)))
    flag, hit, group = (common.free_name(docs.columns, n) for n in ("_may_go", "_goes", "_group"))
    theirs = {n: f"{m}_" for n, m in mine.items()}
    marked = common.marked(keyed, gone.select(*[F.col(n).alias(m) for n, m in mine.items()]), list(mine.values()), flag)
    other = gone.select(*[F.col(n).alias(m) for n, m in theirs.items()], F.col("group").alias(group), F.lit(True).alias(hit))
    same = F.lit(True)
    for n in names:
        same &= F.col(mine[n]).eqNullSafe(F.col(theirs[n])) if n == "doc_id" else F.col(mine[n]) == F.col(theirs[n])
    joined = marked.where(flag).join(other, same, "left")
    out = marked.where(~F.col(flag)).select(*columns).union(joined.where(F.col(hit).isNull()).select(*columns))
    if several:
        row, order = F.struct(*columns), F.to_json(F.struct(*columns))
        out = out.union(joined.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(row, order).alias("row")).select("row.*"))
    return out


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(common.documents(spark, sf_dir))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT r, unnest(list_transform(range(greatest(len(w) - {WORDS - 1}, least(len(w), 1))), lambda i: array_to_string(w[i + 1 : i + {WORDS}], ' '))) AS gram FROM d),
k AS (SELECT r, count(*) AS k FROM g GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN k p ON p.r = x JOIN k q ON q.r = y WHERE shared >= {THRESHOLD} * (p.k + q.k - shared) - 1e-6),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
m AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON r = y GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN m ON m.x = d.r LEFT JOIN n ON n.x = d.r"""

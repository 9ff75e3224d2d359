"""SentencePiece encoding and decoding, with distinct sampled segmentations.

A text's segmentations are the paths of a lattice over the vocabulary's pieces. The k samples are drawn without
replacement by Gumbel top-k: the search keeps open branches with perturbed log probabilities, each the
maximum over the segmentations below it, always follows the largest one, and splits what it leaves behind off
as new branches. The first k paths it completes are the sample; the next perturbed value is the threshold against which
the inclusion scores are computed: log P(a segmentation of this probability exceeds the threshold).

No piece goes on past a blank, so the lattice of a text is a chain of its words' lattices, which are built once per
batch for the distinct words, all at once. A position's branches that are not taken need only their common
mass: their maximum is one truncated Gumbel variable, and which of them it was is drawn when it is followed.
So a whole text costs a few vector operations, however many paths it has.

Random numbers are hashes of the row's key and the place in the text: a row gets the same samples anywhere.

Scores of a unigram model are log probabilities. A BPE model ranks its pieces only; a piece of rank r then gets
a probability in proportion to 1 / (r + ``RANK_SHIFT``). Characters outside the vocabulary become byte pieces.

Defined cases: a null or empty text has one segmentation, the empty one, with probability 1; a text with fewer
than k segmentations gives all it has, each with inclusion 1; a null doc_id has a key of its own; rows that repeat an id draw from the
same random numbers; of branches with equal perturbed values the earliest path's is followed; other columns are not looked at; texts of
any length, with blanks or without, are segmented whole; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from . import common

BLANK = "▁"
SAMPLES, SEED, RANK_SHIFT = 2, 17, 100
#: Bytes of text that are searched at once: the more, the fewer lattices are built again.
SLICE_BYTES = 2 << 20
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
UNIGRAM, BPE = 1, 2


def uniforms(seed: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1), by hashing a seed and a counter (both uint64)."""
    x = seed + count * _MIX
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def gumbel_below(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at these locations, given that they are below top; -inf where the location is."""
    with np.errstate(over="ignore", invalid="ignore"):
        g = location - np.log(np.exp(np.minimum(location - top, 700)) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, np.minimum(g, top))


class Vocabulary:
    """Pieces, their log probabilities, and hashes by which substrings are looked up."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model.ParseFromString(self.processor.serialized_model_proto())
        self.texts = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.bytes = {int(t[1:-1], 16): k for k, (t, kind) in enumerate(zip(self.texts, kinds, strict=True)) if kind == 6}
        self.unknown = kinds.index(2)
        self.normal = [k for k, kind in enumerate(kinds) if kind in (1, 4)]
        raw = np.array([p.score for p in model.pieces])
        if model.trainer_spec.model_type == UNIGRAM:
            self.score = raw
        else:
            rank = np.zeros(len(raw))
            rank[self.normal] = np.argsort(np.argsort(-raw[self.normal], kind="stable"))
            weight = np.zeros(len(raw))
            weight[self.normal] = 1 / (rank[self.normal] + RANK_SHIFT)
            self.score = np.log(np.maximum(weight, 1e-300) / weight.sum())
        self.rare = self.score[self.normal].min() - 1  # of each byte of a character outside the vocabulary
        hashes = {self._hash(self.texts[k]): k for k in self.normal}
        self.sorted = np.array(sorted(hashes), np.uint64)
        self.ids = np.array([hashes[int(h)] for h in self.sorted])
        self.longest = max(len(self.texts[k]) for k in self.normal)
        starts = {self._hash(self.texts[k][:n]) for k in self.normal for n in range(1, len(self.texts[k]) + 1)}
        #: by slot, bit 1: a piece may have this hash; bit 2: a piece may begin so
        self.flags = np.zeros(1 << 20, np.uint8)
        slots = self.slot(self.sorted)
        self.flags[slots] |= 1
        #: a piece of each slot; where a slot has several, bit 3 says that the sorted hashes have to be searched
        self.by_slot = np.zeros(len(self.flags), np.int32)
        self.by_slot[slots] = np.arange(len(self.sorted))
        counts = np.bincount(slots, minlength=len(self.flags))
        self.flags[counts > 1] |= 4
        self.flags[self.slot(np.array(list(starts), np.uint64))] |= 2
        #: whether a text may be cut before a blank that follows another character
        self.cut = not any(BLANK in self.texts[k].lstrip(BLANK) for k in self.normal)
        self.as_bytes = [bytes([int(t[1:-1], 16)]) if kind == 6 else b"" if kind == 3 else t.replace(BLANK, " ").encode() for t, kind in zip(self.texts, kinds, strict=True)]

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h * _MIX) >> np.uint64(44)).view(np.int64)

    def words(self, text: str) -> list[str]:
        """The text's parts between which no piece reaches, each without the blank that begins it."""
        if not text:
            return []
        if not self.cut:
            return [text.replace(" ", BLANK)]
        plain = text.split(" ")
        if "" not in plain and BLANK not in text:
            return plain
        marked = text.replace(" ", BLANK)
        found, at = [], 0
        for k in range(1, len(marked)):
            if marked[k] == BLANK and marked[k - 1] != BLANK:
                found.append(marked[at:k])
                at = k + 1
        # the blank at a cut belongs to the part after it, as its first character
        return [*found, marked[at:]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of piece ids, as UTF-8."""
        out = b"".join(map(self.as_bytes.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """The lattices of words. Nodes are ordered by their distance to the word's end, then by word."""

    def __init__(self, vocab: Vocabulary, words: list[str]) -> None:
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(words), np.int64)  # place of a word among all, longest first
        self.rank[order] = np.arange(len(words))
        codes = np.frombuffer((BLANK + BLANK.join(words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters up to the word's end
        word = np.repeat(self.rank, lengths)
        per_distance = np.bincount(lengths, minlength=int(lengths.max()) + 1)[::-1].cumsum()[::-1]  # words at least so long
        self.base = np.concatenate([[0, 0], np.cumsum(per_distance[1:])])  # first node of each distance, from 1 on
        node = self.base[left] + word
        self.first_node = self.base[lengths] + self.rank

        keys, at, h = [], np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        alone = np.ones(len(codes), bool)
        for n in range(1, vocab.longest + 1):
            if n > 1:
                ok = np.flatnonzero(left[at] >= n)
                at, h = at[ok], h[ok]
            h = h * _BASE + codes[at + n - 1] + np.uint64(1)
            slot = vocab.slot(h)
            flags = vocab.flags[slot]
            maybe = np.flatnonzero(flags & 1)
            k = vocab.by_slot[slot[maybe]]
            several = np.flatnonzero(flags[maybe] & 4)
            k[several] = np.minimum(np.searchsorted(vocab.sorted, h[maybe[several]]), len(vocab.sorted) - 1)
            same = vocab.sorted[k] == h[maybe]
            source = at[maybe[same]]
            keys.append((node[source] << 26) | (n << 20) | vocab.ids[k[same]])
            if n == 1:
                alone[source] = False
            ok = np.flatnonzero(flags & 2)
            at, h = at[ok], h[ok]
        strange = np.flatnonzero(alone)  # characters without a piece of their own
        keys.append((node[strange] << 26) | (1 << 20) | ((1 << 20) - 1))
        key = np.sort(np.concatenate(keys))
        source, length, piece = key >> 26, (key >> 20) & 63, key & ((1 << 20) - 1)
        self.n_nodes = int(self.base[-1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=self.n_nodes))])
        distance = np.repeat(np.arange(1, len(self.base) - 1), np.diff(self.base[1:]))[source]
        self.target = np.where(distance > length, self.base[distance - length] - self.base[distance] + source, -1)
        self.strange: dict[int, int] = {}  # the edges that stand for a character without a piece
        if len(strange):
            odd = np.flatnonzero(piece == (1 << 20) - 1)
            of_node = np.empty(self.n_nodes, np.int64)
            of_node[node] = codes
            self.strange = dict(zip(odd.tolist(), of_node[source[odd]].tolist(), strict=True))
            piece[odd] = vocab.unknown
        self.piece = piece
        score = vocab.score[piece]
        for edge, char in self.strange.items():
            score[edge] = vocab.rare * len(chr(char).encode("utf-8", "surrogatepass"))
        beta = np.zeros(self.n_nodes + 1)  # the last one: the end of a word, at target -1
        value, self.p = np.empty(len(score)), np.empty(len(score))
        for d in range(1, len(self.base) - 1):
            a, b = self.base[d], self.base[d + 1]
            lo, hi = self.first[a], self.first[b]
            v = score[lo:hi] + beta[self.target[lo:hi]]
            starts = self.first[a:b] - lo
            top, widths = np.maximum.reduceat(v, starts), np.diff(np.append(starts, hi - lo))
            share = np.exp(v - np.repeat(top, widths))
            whole = np.add.reduceat(share, starts)
            beta[a:b] = top + np.log(whole)
            value[lo:hi], self.p[lo:hi] = v, share / np.repeat(whole, widths)
        self.logp = value - beta[source]
        total = np.cumsum(self.p)
        self.below = total - np.concatenate([[0], total])[self.first[source]]  # up to and with each edge of its node
        self.last = self.first[1:] - 1
        # what all other edges of the node have together
        self.rest = np.log1p(-np.minimum(self.p, 1 - 1e-15))
        self.rest[self.first[:-1][np.diff(self.first) == 1]] = -np.inf

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node."""
        edge, last = self.first[node], self.last[node]
        open_ = np.flatnonzero((edge < last) & (self.below[edge] < u))
        while len(open_):
            edge[open_] += 1
            e = edge[open_]
            open_ = open_[(e < last[open_]) & (self.below[e] < u[open_])]
        return edge

    def walk(self, node: np.ndarray, seed: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node (-1: nothing) to its word's end: how many edges, and all edges in order."""
        steps, counts = [], np.zeros(len(node), np.int64)
        active = np.flatnonzero(node >= 0)
        now, k = node[active], 0
        while len(active):
            edge = self.choose(now, uniforms(seed[active], count[active] + np.uint64(k)))
            steps.append((active, edge))
            counts[active] += 1
            now = self.target[edge]
            going = now >= 0
            active, now, k = active[going], now[going], k + 1
        place = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for k, (active, edge) in enumerate(steps):
            out[place[active] + k] = edge
        return counts, out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of these runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Search:
    """The perturbed search for a batch of texts at once."""

    def __init__(self, vocab: Vocabulary, texts: list[str], seeds: np.ndarray, samples: int) -> None:
        self.vocab, self.n = vocab, len(texts)
        split = [vocab.words(t) for t in texts]
        self.n_words = np.array([len(w) for w in split])
        owner, index = pd.factorize(np.array([*chain.from_iterable(split)], dtype=object))
        self.seeds = seeds.astype(np.uint64)
        self.word_start = np.concatenate([[0], np.cumsum(self.n_words)])
        if not len(index):
            self.lattices = None
            return
        self.lattices = Lattices(vocab, index.tolist())
        self.node = self.lattices.first_node[owner]
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        #: a counter for random numbers that is the place of the word in its text
        self.count = (np.arange(len(self.node)) - self.word_start[self.doc]).astype(np.uint64) << np.uint64(24)
        self.paths: list[dict] = []
        live = self.n_words > 0
        top = np.where(live, -np.log(-np.log(uniforms(self.seeds, np.full(self.n, 1 << 63, np.uint64)))), -np.inf)
        self._first(live, top)
        for _ in range(1, samples):
            if not self._next():
                break
        self.threshold = self._best()[0]

    def _stream(self, number: int, doc: np.ndarray, odd: int) -> np.ndarray:
        return self.seeds[doc] ^ np.uint64((2 * number + odd) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)

    def _add(self, edges: np.ndarray, word: np.ndarray, lengths: np.ndarray, top: np.ndarray, open_from: np.ndarray) -> None:
        """A path for each text; its positions from open_from on are new branches below top."""
        number, start = len(self.paths), np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(self.n), lengths)
        logp = self.lattices.logp[edges]
        total = np.concatenate([[0.0], np.cumsum(logp)])
        before = total[:-1] - total[start][doc]
        location = before + self.lattices.rest[edges]
        location[np.arange(len(edges)) - start[doc] < open_from[doc]] = -np.inf
        place = (np.arange(len(edges)) - start[doc]).astype(np.uint64)
        bound = gumbel_below(location, top[doc], uniforms(self._stream(number, doc, 1), place))
        self.paths.append({"edges": edges, "word": word, "start": start, "length": lengths, "before": before, "bound": bound, "total": total[start + lengths] - total[start], "top": top, "taken": []})

    def _first(self, live: np.ndarray, top: np.ndarray) -> None:
        counts, edges = self.lattices.walk(self.node, self._stream(0, self.doc, 0), self.count)
        word = np.repeat(np.arange(len(self.node)), counts)
        lengths = np.bincount(self.doc, counts, self.n).astype(np.int64)
        self._add(edges, word, lengths, top, np.zeros(self.n, np.int64))

    def _best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest open bound of each text, its path and its position there."""
        value, which, where = np.full(self.n, -np.inf), np.full(self.n, -1), np.zeros(self.n, np.int64)
        for k, path in enumerate(self.paths):
            some = np.flatnonzero(path["length"] > 0)
            if not len(some):
                continue
            most = np.maximum.reduceat(path["bound"], path["start"][some])
            top = np.full(self.n, -np.inf)
            top[some] = most
            doc = np.repeat(np.arange(self.n), path["length"])
            hits = np.flatnonzero((path["bound"] == top[doc]) & (top[doc] > -np.inf))
            docs, firsts = np.unique(doc[hits], return_index=True)
            better = top[docs] > value[docs]
            docs, at = docs[better], hits[firsts[better]]
            value[docs], which[docs], where[docs] = top[docs], k, at - path["start"][docs]
        return value, which, where

    def _next(self) -> bool:
        """Follow the best open branch of each text to a complete path."""
        value, which, where = self._best()
        going = np.flatnonzero(which >= 0)
        if not len(going):
            return False
        number, lat = len(self.paths), self.lattices
        at = np.array([self.paths[which[d]]["start"][d] + where[d] for d in going])
        old = np.array([self.paths[which[d]]["edges"][i] for d, i in zip(going, at, strict=True)])
        word = np.array([self.paths[which[d]]["word"][i] for d, i in zip(going, at, strict=True)])
        node = np.searchsorted(lat.first, old, "right") - 1
        # one of the node's edges that no path has taken from here
        choices = lat.first[node][:, None] + np.arange(int((lat.last[node] - lat.first[node]).max()) + 1)
        real = choices <= lat.last[node][:, None]
        mass = np.where(real, lat.p[np.minimum(choices, len(lat.p) - 1)], 0.0)
        mass[choices == old[:, None]] = 0
        for row, (d, i) in enumerate(zip(going, at, strict=True)):
            for pos, edge in self.paths[which[d]]["taken"]:
                if pos == i:
                    mass[row][choices[row] == edge] = 0
        grown = np.cumsum(mass, 1)
        u = uniforms(self._stream(number, going, 0), np.full(len(going), (1 << 63) + 1, np.uint64)) * grown[:, -1]
        pick = np.minimum((grown <= u[:, None]).sum(1), mass.shape[1] - 1)
        pick = np.where(mass[np.arange(len(pick)), pick] > 0, pick, mass.argmax(1))
        edge = choices[np.arange(len(pick)), pick]
        # what remains open where the branch left its path
        mass[np.arange(len(pick)), pick] = 0
        remains = mass.sum(1)
        with np.errstate(divide="ignore"):
            before = np.array([self.paths[which[d]]["before"][i] for d, i in zip(going, at, strict=True)])
            location = before + np.where(remains > 1e-15, np.log(remains), -np.inf)
        again = gumbel_below(location, value[going], uniforms(self._stream(number, going, 0), np.full(len(going), (1 << 63) + 2, np.uint64)))
        for d, i, g, e in zip(going, at, again, edge, strict=True):
            self.paths[which[d]]["bound"][i] = g
            self.paths[which[d]]["taken"].append((i, e))
        # the rest of the word, then all words after it
        tail_words = self.word_start[going + 1] - word
        tail = _ragged(word, tail_words)
        nodes, head = self.node[tail], np.cumsum(tail_words) - tail_words
        nodes[head] = lat.target[edge]
        count = self.count[tail].copy()
        count[head] += np.uint64(1 << 20)
        counts, walked = lat.walk(nodes, self._stream(number, self.doc[tail], 0), count)
        per_doc = np.add.reduceat(counts, head)
        lengths = np.zeros(self.n, np.int64)
        lengths[going] = where[going] + 1 + per_doc
        start = np.cumsum(lengths) - lengths
        edges, words = np.empty(int(lengths.sum()), np.int64), np.empty(int(lengths.sum()), np.int64)
        for k in range(number):
            from_k = going[which[going] == k]
            source = _ragged(self.paths[k]["start"][from_k], where[from_k])
            to = _ragged(start[from_k], where[from_k])
            edges[to], words[to] = self.paths[k]["edges"][source], self.paths[k]["word"][source]
        edges[start[going] + where[going]], words[start[going] + where[going]] = edge, word
        to = _ragged(start[going] + where[going] + 1, per_doc)
        edges[to], words[to] = walked, np.repeat(tail, counts)
        top = np.full(self.n, -np.inf)
        top[going] = value[going]
        open_from = np.zeros(self.n, np.int64)
        open_from[going] = where[going] + 1
        self._add(edges, words, lengths, top, open_from)
        return True

    def found(self) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
        """text, sample, ids, log probability, perturbed value, log inclusion."""
        none = np.zeros(0, np.int32)
        if self.lattices is None:
            for d in range(self.n):
                yield d, 0, none, 0.0, 0.0, 0.0
            return
        flat = [self._ids(p) for p in self.paths]
        for d in range(self.n):
            if not self.n_words[d]:
                yield d, 0, none, 0.0, 0.0, 0.0
                continue
            for k, path in enumerate(self.paths):
                if path["length"][d]:
                    a, over = path["total"][d], path["total"][d] - self.threshold[d]
                    inclusion = 0.0 if over > 5 else over if over < -30 else float(np.log(-np.expm1(-np.exp(over))))
                    ids, starts = flat[k]
                    yield d, k, ids[starts[d] : starts[d + 1]], float(a), float(path["top"][d]), inclusion

    def _ids(self, path: dict) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of a path's edges, bytes written out, and where each text's begin."""
        lat, edges, bounds = self.lattices, path["edges"], np.append(path["start"], len(path["edges"]))
        ids = lat.piece[edges].astype(np.int32)
        if not lat.strange or not self.vocab.bytes:
            return ids, bounds
        odd = np.flatnonzero(np.isin(edges, np.fromiter(lat.strange, np.int64)))
        raw = [chr(lat.strange[e]).encode("utf-8", "surrogatepass") for e in edges[odd].tolist()]
        width = np.ones(len(edges), np.int64)
        width[odd] = [len(b) for b in raw]
        ids, place = np.repeat(ids, width), np.cumsum(width) - width
        at = _ragged(place[odd], width[odd])
        ids[at] = [self.vocab.bytes[b] for b in b"".join(raw)]
        return ids, np.append(place, len(ids))[bounds]


def sample_segmentations(docs: DataFrame, model: str | None = None, samples: int = SAMPLES, seed: int = SEED, digest: bool = False) -> DataFrame:
    """Per document and sample (0: the first drawn): doc_id, sample, n_pieces, log_prob, perturbed, log_inclusion, decoded, and
    the ids, or with digest only their CRC-32. decoded says whether the ids give the text back."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    last = ("ids_crc32", pa.int64(), "long") if digest else ("ids", pa.list_(pa.int32()), "array<int>")
    names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "decoded", last[0]]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), last[1]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in common.slices_by_size(batches, "text", SLICE_BYTES):
            texts, doc_ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            search = Search(vocab, texts, batch["key"].to_numpy().view(np.uint64), samples)
            rows = []
            for d, k, ids, log_prob, perturbed, inclusion in search.found():
                whole = vocab.decode(ids) == texts[d].replace(BLANK, " ").encode("utf-8", "surrogatepass")
                rows.append((doc_ids[d], k, len(ids), log_prob, perturbed, inclusion, whole, zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    keyed = docs.select(common.long_id(), common.text_column().alias("text"), F.xxhash64(F.lit(seed), "doc_id").alias("key"))
    return keyed.mapInArrow(task, f"doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, decoded boolean, {last[0]} {last[2]}")


def decode_ids(rows: DataFrame, model: str | None = None) -> DataFrame:
    """The rows' ids (a column ids) as text, in a column text beside doc_id and sample."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in common.slices(batches, 512):
            texts = [vocab.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sample"], pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return rows.select("doc_id", "sample", "ids").mapInArrow(task, "doc_id long, sample int, text string")


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(common.documents(spark, sf_dir), digest=True)

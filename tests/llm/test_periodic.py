import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.llm import common, periodic


def by_hand(words):
    """Start, end and period of each run, by comparing every word with that a period before, for every period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        j = p
        while j < n:
            k = j
            while k < n and words[k] == words[k - p]:
                k += 1
            if k - j >= p and k - j + p >= 12:
                found.setdefault((j - p, k), p)
            j = k + 1
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def caught(words, steps):
    catcher, at = periodic.SquareCatcher(), 0
    for step in steps:
        catcher.append(np.array(words[at : at + step], np.int64))
        at += step
    catcher.append(np.array(words[at:], np.int64))
    return catcher.runs()


def shapes(rng):
    """Sequences with runs within runs, at the ends, side by side, and in one word."""
    alphabet = rng.choice([1, 2, 3, 30])
    out = [rng.randrange(alphabet) for _ in range(rng.randrange(40))]
    for _ in range(rng.randrange(1, 4)):
        unit = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 25))] * rng.randrange(1, 6)
        out += unit + out[: rng.randrange(len(out) + 1)] * rng.randrange(1, 3) + [rng.randrange(alphabet)]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        words = shapes(rng)
        want = by_hand(words)
        assert caught(words, []) == want
        assert caught(words, [rng.randrange(1, 9) for _ in words]) == want


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 5))
def test_runs_after_each_word(words, step):
    catcher = periodic.SquareCatcher()
    for at in range(0, len(words), step):
        catcher.append(np.array(words[at : at + step], np.int64))
        assert catcher.runs() == by_hand(words[: at + step])


def test_words_that_defeat_hashes():
    """The Thue-Morse sequence, on which sums modulo a power of two coincide."""
    words = [bin(k).count("1") & 1 for k in range(1 << 12)]
    assert caught(words, []) == by_hand(words)


def test_long_texts_of_few_words():
    n = 200_000
    assert caught([7] * n, []) == [(0, n, 1)]
    words = ([1] * 400 + [2]) * 40
    assert (0, len(words), 401) in caught(words, []) and len(caught(words, [])) == 41


def test_texts_do_not_run_into_each_other():
    texts = [["a"] * 12, ["a"] * 12, [], ["b", "c"] * 5, ["b", "c"] * 6, ["x"]]
    assert periodic.runs_of(texts) == [[(0, 12, 1)], [(0, 12, 1)], [], [], [(0, 12, 2)], []]


def rows_by_hand(rows):
    out = []
    for doc_id, text in rows:
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
        h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = by_hand(words)
        gone = {i for a, b, p in runs for i in range(a + p, b)}
        best = min(((a - b, a, p) for a, b, p in runs), default=None)
        lines = "".join(f"{a},{b - a},{p}\n" for a, b, p in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_digests(spark, docs):
    got = [tuple(r) for r in periodic.digests(periodic.find_runs(docs, loops=True)).collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    short = {r[0] for r in rows if len(r[1] or "") < 20_000}
    assert len(got) == len(rows)
    assert sorted((r for r in got if r[0] in short), key=str) == rows_by_hand([r for r in rows if r[0] in short])
    assert periodic.digests(periodic.find_runs(docs.limit(0))).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "1 AS id", "2 AS runs", "3 AS collapsed")
    assert periodic.find_runs(clashing).count() == len(rows)


def test_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in periodic.op13_periodic_runs(spark, sf).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in common.documents(spark, sf).select("doc_id", "text").collect() if len(r["text"] or "") < 12_000]
    want, ids = rows_by_hand(rows), {r[0] for r in rows}
    assert [r for r in got if r[0] in ids] == want and any(r[1] for r in want) and len(ids) > 150

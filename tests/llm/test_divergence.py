import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from eventide.llm import divergence


def by_hand(rows, least=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {r[0] for r in rows}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        sources = sorted({r[1] for r in rows if r[0] == lang})

        def shares(held):
            n = sum(held[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (held[t] + 1) // (n + len(kept)) for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        over = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = [(-sum(over(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-over(own[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(None, t, lg, s, 1, 2, 3, 4) for lg, s, t in rows], "doc_id long, text string, lang string, source string, n int, term int, block int, value int")


def audited(spark, rows, **options):
    return sorted(tuple(r) for r in divergence.audit(table(spark, rows), **options).collect())


@pytest.mark.parametrize("options", [{}, {"tile": 8, "block": 16, "ranks": 5}])
def test_groups_by_brute_force(spark, options):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("the", "Straße", "ÄB", "x", "漢字", "q_r", "n2") for b in "abcdefgh"]
    rows = []
    for k in range(260):
        lang = ["en", "de", None, "fr", ""][rng.integers(5)]
        source = [None, "", *[f"s{i}" for i in range(20)]][rng.integers(22)]
        rows.append((lang, source, " ".join(rng.choice(words[: 8 + rng.integers(len(words))], rng.integers(0, 12)))))
    rows += [("en", "empty", ""), ("en", "null", None), ("one", "alone", "a b c"), ("xx", "a", "once"), ("xx", "b", "twice"), ("tie", "a", "p q r"), ("tie", "b", "p q r"), ("tie", "c", "p q r " * 900), ("tie", "b", "p q r")]
    assert audited(spark, rows, **options) == by_hand(rows, ranks=options.get("ranks", 200))
    assert audited(spark, []) == []


def test_trees_by_brute_force():
    rng = np.random.default_rng(3)
    for rows, other, columns in ((5, 9, 70), (16, 16, 16), (4, 3, 4), (20, 20, 0), (30, 2, 9)):
        trees, full, height = [], [], 0
        while divergence.LEAF << height < max(rows, other, columns):
            height += 1
        for n in (rows, other):
            cells = np.argwhere(rng.random((n, columns)) < 0.15)
            zero, value = rng.integers(1, 1000, n), rng.integers(1, 10**9, len(cells))
            dense = np.repeat(zero[:, None], columns, 1)
            dense[cells[:, 0], cells[:, 1]] = value
            trees.append(divergence.QuadTree.build(cells[:, 0], cells[:, 1], value, zero, height))
            full.append(dense)
        p, q = full[0][:, None, :], full[1][None, :, :]
        want = ((p - q) ** 2 // q).sum(2), ((p - q) ** 2 // p).sum(2)
        got = divergence.divergences(*trees, (rows, other), columns)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


@pytest.mark.parametrize("most", [10**9, 3000])
def test_quotients_are_exact(most):
    rng = np.random.default_rng(4)
    by = rng.integers(1, most, 200_000)
    difference = rng.integers(-most, most, 200_000)
    some = by * rng.integers(1, 50, 200_000)  # squares near multiples
    for d in (difference, np.sqrt(some).astype(np.int64)):
        assert (divergence.quotients(d, by) == d**2 // by).all()


def test_sql_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in divergence.op11_source_divergence(spark, sf).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(db.sql(divergence.ORACLE).fetchall()) and len(got) > 1000

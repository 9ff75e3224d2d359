import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from eventide.llm import common, neardup
from eventide.llm.components import connected_components


def by_hand(rows, threshold=0.8):
    """n_links and component of each row by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().encode().translate(neardup.FOLD).split()
        width = min(5, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    root = list(range(len(rows)))
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(root[i], []).append(doc_id)
    return Counter((d, links[i], min((x for x in least[root[i]] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def made_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for group in range(30):
        base = [word() for _ in range(rng.randint(8, 120))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    return rows + [(None, rows[3][1]), (rows[4][0], rows[4][1]), (5000, None), (5001, ""), (5002, ""), (5003, "?!"), (5004, "one two"), (5005, "One, two."), (5006, "long " + " ".join(word() for _ in range(30000)))]


@pytest.mark.parametrize(("block", "most"), [(512, 1_000_000), (7, 0)])
def test_groups_by_brute_force(spark, monkeypatch, block, most):
    """Also with small blocks, and with joins that shuffle."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, cid string")
    got = neardup.join_similar(docs, block=block).collect()
    assert Counter((r["doc_id"], r["n_links"], r["component_id"]) for r in got) == by_hand(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_one_of_each_group_stays(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, cid string")
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    groups = by_hand(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in groups})
    assert neardup.join_similar(docs.limit(0)).count() == 0


def test_no_row_is_lost_with_equal_ids(spark):
    """Rows without words all stay; of rows with the smallest id of a group the first stays, whatever groups share the id."""
    same = "a b c d e f g"
    rows = [(None, "", "x"), (None, "", "x"), (None, "", "y"), (4, "?!", "x"), (4, "?!", "x"), (3, same, "z"), (3, same, "y"), (3, same, "y"), (5, same, "a"), (3, "other words that are unlike", "q"), (None, "nobody knows my id", "b"), (None, "nobody knows my id", "a"), (None, "and nobody knows mine", "c")]
    docs = spark.createDataFrame([(i, t, s, "k") for i, t, s in rows], "doc_id long, text string, source string, _key_cid string")
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    expected = [*rows[:5], (3, same, "y"), (3, "other words that are unlike", "q"), (None, "nobody knows my id", "a"), (None, "and nobody knows mine", "c")]
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in kept.collect()) == Counter(expected)


def test_a_long_chain_costs_in_proportion(spark):
    """Texts that each share half of their n-grams with the next are one chain of candidates, but not one group."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(40 * 3000 + 200)]
    docs = spark.createDataFrame([(i, " ".join(words[40 * i : 40 * i + 124])) for i in range(3000)], "doc_id long, text string")
    bands, rows = neardup.plan_bands()
    classes = neardup.classes_of(common.materialize(neardup.sign(docs, 5, bands, rows), "signed"))
    members = neardup.candidate_groups(classes)
    sizes = members.selectExpr("id", "explode(groups) AS g").selectExpr("id", "g.leader", "g.members").toPandas()
    assert sizes.id.nunique() > 1500  # the chain is there
    assert sizes.groupby("leader").members.first().pow(2).sum() < 20 * 3000
    assert neardup.join_similar(docs).selectExpr("sum(n_links)").first()[0] == 0


def test_each_candidate_pair_is_compared_once(spark):
    """Pairs under their smallest common leader, against all pairs that share a band."""
    docs = spark.createDataFrame(made_rows(), "doc_id long, text string")
    bands, rows = neardup.plan_bands()
    classes = neardup.classes_of(common.materialize(neardup.sign(docs, 5, bands, rows), "signed"))
    held = {r["id"]: set(r["bands"]) for r in classes.collect()}
    shared = {(i, j) for i in held for j in held if i < j and held[i] & held[j]}
    compared = Counter()
    groups = {}
    for r in neardup.candidate_groups(classes).collect():
        for g in r["groups"]:
            groups.setdefault(g["leader"], []).append((r["id"], set(r["leaders"])))
    for leader, members in groups.items():
        for i, a in members:
            for j, b in members:
                if i < j and min(a & b) == leader:
                    compared[i, j] += 1
    assert max(compared.values()) == 1 and shared <= set(compared)


def test_whole_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = neardup.op6_ngram_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r["doc_id"], r["n_links"], r["component_id"]) for r in got) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_whole_table_by_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.execute(neardup.ORACLE).fetchall()
    assert sorted(map(tuple, neardup.op6_ngram_jaccard_join(spark, sf).collect())) == sorted(expected) and any(r[1] for r in expected)


def test_bands_reach_the_recall():
    bands, rows = neardup.plan_bands()
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    signer = neardup.Signer(5, bands, rows)
    rng = np.random.default_rng(0)
    shares = []
    for _ in range(60):
        both, a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 50, dtype=np.uint64), rng.integers(0, 2**63, 50, dtype=np.uint64)
        shares.append((signer.signature(np.concatenate([both, a])) == signer.signature(np.concatenate([both, b]))).mean())
    assert abs(np.mean(shares) - 0.8) < 0.02


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (2000, 1001)]
    random.Random(1).shuffle(pairs)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 2000: 1000}

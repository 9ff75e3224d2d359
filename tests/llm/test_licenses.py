import random
import re

import duckdb

from eventide.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.",
    "Licensed under CC BY-NC 4.0. cc/by cc by and ALL RIGHTS\nRESERVED all rights reservéd",
    "Released under the MIT License. mit license",
    "Licensed under the Apache License, Version 2.0.",
    "general public general public license cc cc by",
    None,
    "",
    "",
    "ccby É2 ②",
    "filler " * 30000 + "all rights reserved" + " filler" * 30000,
]


def by_hand(text):
    words = [w for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    places = {}
    for t in licenses.TEMPLATES:
        key = t.key.split()
        if at := [i for i in range(len(words)) if words[i : i + len(key)] == key]:
            places.setdefault(t.label, []).extend(at)
    base = {t.label for t in licenses.BASE}
    starts = [p for label in base for p in places.get(label, [])]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base & set(places))), ",".join(sorted(places))


def test_places_by_brute_force(spark):
    docs = spark.createDataFrame([(i if i != 7 else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i if i != 7 else None]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == by_hand(text)
    assert got[2]["score"] == 1 and 0 < got[0]["score"] <= 1 and got[6]["score"] == 0
    assert licenses.scan(docs.limit(0)).count() == 0


def test_whole_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in licenses.op8_license_scans(spark, "/root/testdata/sf0.01").collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == by_hand(texts[r["doc_id"]])


def test_a_whole_table_by_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.execute(licenses.ORACLE)
    names = [d[0] for d in expected.description]
    got = licenses.op8_license_scans(spark, sf)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


def test_odd_rows_by_sql(spark, tmp_path):
    spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(TEXTS[:-1])], "doc_id long, text string").write.parquet(f"file://{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = licenses.scan(spark.read.parquet(f"file://{tmp_path}/d")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(licenses.ORACLE).fetchall()))


def test_rare_words_agree_on_a_place():
    """The postings of several words are intersected: only places on which they agree are verified."""
    rng = random.Random(4)
    key = licenses.words_of("permission is hereby granted free of charge")
    words = [rng.choice(key) for _ in range(4000)] + licenses.MORE[14].text.encode().split() + [rng.choice(key) for _ in range(4000)]
    index = licenses.TemplateIndex(frequency={w: k for k, w in enumerate(key)})
    t = index.keys.index(key)
    present = index.vocabulary.intersection(words)
    tops = index.tops(words, present)[t]
    assert index.places(words, present)[t][4000] == 1 and 4000 in tops
    assert len(tops) < 0.1 * sum(w == key[0] for w in words)


def edited(rng, template, changes):
    """The text with so many words replaced, outside its key phrase."""
    words, at = licenses.words_of(template.text), 0
    key = licenses.words_of(template.key)
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    for i in rng.sample([i for i in range(len(words)) if not at <= i < at + len(key)], changes):
        words[i] = b"xx"
    return b" ".join(words).decode()


def whole_texts():
    rng, out = random.Random(6), []
    filler = [w.decode() for t in licenses.WHOLE_TEMPLATES[:4] for w in licenses.words_of(t.text)]
    for k, t in enumerate(licenses.WHOLE_TEMPLATES):
        n = len(licenses.words_of(t.text)) - len(licenses.words_of(t.key))
        around = [" ".join(rng.choices(filler, k=rng.randrange(60))) for _ in range(2)]
        out += [(t.label, t.text), (t.label, f"{around[0]} {t.text.upper()}\n{around[1]}"), (None, f"{around[0]} {edited(rng, t, int(0.1 * n))} {around[1]}"), (None, edited(rng, t, int(0.6 * n))), (None, t.key)]
    return out


def test_whole_texts_are_found(spark, tmp_path):
    """Whole licences, in other text, edited, and cut to their key phrase, against SQL and by hand."""
    cases = whole_texts()
    rows = [(k, text) for k, (_, text) in enumerate(cases)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = {r["doc_id"]: r for r in licenses.scan(spark.read.parquet(f"file://{tmp_path}/d")).collect()}
    assert sorted(map(str, map(tuple, got.values()))) == sorted(map(str, con.execute(licenses.ORACLE).fetchall()))
    for k, (label, _) in enumerate(cases):
        if label:
            assert label in got[k]["whole_labels"].split(",") and got[k]["whole_share"] == 1
        elif k % 5 == 4:
            assert got[k]["whole_share"] < 1
    labels = {t.label for t in licenses.WHOLE_TEMPLATES}
    assert len(labels) >= 24 and sum(bool(got[k]["whole_labels"]) for k in range(2, len(cases), 5)) >= 0.9 * len(licenses.WHOLE_TEMPLATES)
    assert not any(got[k]["whole_labels"] for k in range(3, len(cases), 5))


def test_anchors_of_whole_texts_by_brute_force():
    rng = random.Random(8)
    frequency = {w: rng.randrange(50) for w in licenses.WholeIndex().vocabulary}
    index = licenses.WholeIndex(frequency=frequency)
    for _, text in whole_texts():
        words = licenses.words_of(text)
        got = index.places(words, index.vocabulary.intersection(words))
        for t, template in enumerate(index.words):
            anchors = sorted({w for w in template if w in words}, key=lambda w: (frequency[w], w))[:8]
            key, at = index.keys[t], index.key_at[t]
            want = set()
            if set(key) <= set(words):
                for top in range(-len(template), len(words)):
                    agree = sum(any(0 <= top + r < len(words) and words[top + r] == w for r in range(len(template)) if template[r] == w) for w in anchors)
                    if agree >= min(3, len(anchors)) and top + at >= 0 and words[top + at : top + at + len(key)] == key:
                        want.add(top + at)
            assert set(got.get(t, {})) == want

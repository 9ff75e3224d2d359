import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from eventide.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    got = quality.op7_quality_classifier(spark, SF).toPandas()
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    table = quality.feature_table(docs).cache()
    x = np.random.default_rng(0).random((50, len(quality.FEATURES)))
    assert (quality.fit_on(table, quality.training_labels(labels)).scores(x) == quality.fit_on(table, quality.training_labels(turned)).scores(x)).all()
    table.unpersist()


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, None), (99, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).count() == docs.count()
    empty = quality.score(docs, labels.limit(0)).toPandas()
    assert (empty.score == 0.5).all()
    assert quality.score(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    unknown = quality.keep_good(docs, labels.where("doc_id = 99"))  # labelled, but there is no such document
    assert unknown.columns == docs.columns and unknown.count() == quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_pairs_explain_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert {1, 4} == set(model.pairs[0][:2])
    z = rng.random((1000, len(quality.FEATURES)))
    assert ((model.scores(z) > 0.5) == ((z[:, 1] > 0.5) ^ (z[:, 4] > 0.5))).mean() > 0.9


def test_held_out_language(spark):
    got = language.op5_language_id(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got[got.held_out].merge(docs, on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.97


def test_language_of_odd_rows(spark, docs):
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[2]["score"] == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0
    assert language.keep_identified(docs).columns == docs.columns


def test_text_vectors_are_sums_of_bound_letters():
    profiles = language.Profiles(64)
    (one, sizes) = profiles.encode(["ab", "ab" * 3000, ""], columns=3)
    table = language._symbols()
    a, b, space = profiles.letters[table[ord("a")]], profiles.letters[table[ord("b")]], profiles.letters[0]
    by_hand = np.roll(space, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * space
    assert (one[0] == by_hand).all() and not one[2].any() and sizes.tolist() == [2, 6000, 0]
    far, _ = profiles.encode(["ab", "中文"])  # beside letters with code points of their own, the same vector
    assert (far[0] == by_hand).all() and far[1].any()


def slow_vector(text, dimensions=language.DIMENSIONS):
    """Trigram by trigram."""
    letter = lambda c: language.letter_vectors(np.array([language._symbols()[ord(c)]]), dimensions)[0].astype(int)
    spaced = "".join(c if c.isalpha() else " " for c in f" {text} ")
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    out = np.zeros(dimensions, int)
    for x, y, z in zip(spaced, spaced[1:], spaced[2:]):
        if y != " ":
            out += np.roll(letter(x), 2) * np.roll(letter(y), 1) * letter(z)
    return out


def test_language_by_brute_force(spark):
    """Prototypes and predictions of a table, trigram by trigram, with a rare language in another script."""
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], (r["text"] or "")[:600], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += [(9001 + k, t, "zh") for k, t in enumerate(["中文文本在这里", "这里的文本是中文", "天气很好 我们去公园", "公园里的天气"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vectors = np.array([slow_vector(t) for _, t, _ in rows], float)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    units = vectors / np.where(norms > 0, norms, 1)
    train = [k for k, (i, _, lang) in enumerate(rows) if lang and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({rows[k][2] for k in train})
    prototypes = np.array([sum(units[k] for k in train if rows[k][2] == lang) for lang in langs])
    cosines = units @ (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).T
    for r in language.identify(docs).collect():
        k = [i for i, _, _ in rows].index(r["doc_id"])
        assert r["lang_pred"] == (langs[cosines[k].argmax()] if norms[k] else "und")
        assert abs(r["score"] - max(cosines[k].max(), 0)) < 1e-4


def test_rare_languages_are_learned(spark):
    rows = [(k, "the and of that with this " * 3, "en") for k in range(3000)] + [(5000 + k, "und der die das nicht mit " * 3, "de") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train(docs, per_language=20).langs == ["de", "en"]
    assert language.chosen_rows(docs, 20).where("lang = 'de'").count() == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, _, lang in rows if lang == "de")


def test_every_training_row_counts(spark):
    """Of more rows than a sample of 5,000 would hold, the model learns from each, the low cosines included."""
    rows = [(k, "the and of that" if k != 7000 else "zum beispiel hier", "en") for k in range(7001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert language.chosen_rows(docs).count() == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k, _, _ in rows)
    units = [slow_vector(t) / np.linalg.norm(slow_vector(t)) for t in ("the and of that", "zum beispiel hier")]
    n = sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(7000))
    expected = n * units[0] + (zlib.crc32(b"7000") % 5 > 0) * units[1]
    model = language.train(docs, floors=True)
    assert np.abs(model.prototypes[0] - expected / np.linalg.norm(expected)).max() < 1e-7
    assert min(model.floors.values()) > 0.9


def test_the_stage_rejects_what_is_in_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(90_001, "qzx wvk jjq xzzv kqqw " * 40), (90_002, "это русский текст о погоде и природе " * 10), (90_003, "12345 ...")], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    kept = language.keep_identified(both)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and not ids & {90_001, 90_002, 90_003} and len(ids) >= 0.97 * docs.count()
    german = language.keep_identified(both, ["de"])
    assert 0 < german.count() < len(ids) and german.where("lang = 'de'").count() > 0.9 * german.count()
    none = language.keep_identified(both.withColumn("lang", F.lit(None).cast("string")))
    assert none.count() == both.where("text rlike '\\\\p{L}'").count()


def slow_features(text):
    """Character by character, in the order of quality.FEATURES."""
    if not text:
        return [0.0] * 12
    words, lines, n = text.split(), text.split("\n"), len(text)
    kind = lambda c: "upper" if c.isupper() else "lower" if c.isalpha() else "digit" if c.isdigit() else "newline" if c == "\n" else "space" if c.isspace() else "marks" if c in ".,;:'\"()-?" else "symbols" if ord(c) < 128 else "other"
    share = lambda k: sum(kind(c) == k for c in text) / n
    w = max(len(words), 1)
    solid = sum(kind(c) not in ("space", "newline") for c in text)
    return [np.log1p(n), *map(share, ("upper", "digit", "space", "newline", "marks", "symbols", "other")), min(solid / w, 50), len(set(words)) / w, sum(len(x) > 15 for x in words) / w, len(set(lines)) / len(lines)]


def test_quality_by_brute_force(spark):
    """Features one by one, a fit on all labelled rows outside the fold, and scores by looking entries up one by one."""
    sf = "/root/testdata/sf0.001"
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    x = {i: slow_features(t or "") for i, t in zip(docs.doc_id, docs.text)}
    train = sorted((i, q) for i, q in zip(labels.doc_id, labels.quality) if i in x and zlib.crc32(str(i).encode()) % 4 != 2)
    model = quality.fit(np.array([x[i] for i, _ in train]), np.array([q for _, q in train], float))
    for r in quality.op7_quality_classifier(spark, sf).collect():
        bins = [sum(v >= e for e in edges) for v, edges in zip(x[r["doc_id"]], model.edges)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[i] * quality.PAIR_BINS // quality.BINS, bins[j] * quality.PAIR_BINS // quality.BINS] for i, j, t in model.pairs)
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-6


def test_training_rows_do_not_depend_on_the_order(spark):
    """Repeated ids, beyond the bound."""
    rows = [(k % 7, f"text {k} " * (k % 13 + 1)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7)], "doc_id long, quality int, toxic int")
    x = np.random.default_rng(0).random((20, len(quality.FEATURES)))
    most, quality.TRAIN_ROWS = quality.TRAIN_ROWS, 30
    try:
        scores = [quality.fit_on(quality.feature_table(d), quality.training_labels(labels)).scores(x) for d in (docs, docs.orderBy(F.desc("text")), docs.repartition(3))]
    finally:
        quality.TRAIN_ROWS = most
    assert (scores[0] == scores[1]).all() and (scores[0] == scores[2]).all()

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from eventide.llm import common, language, neardup, quality, secrets
from eventide.sources import files
from tests.llm.test_neardup import by_hand
from tests.llm.test_tokens import check_sequences

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_stages_against_brute_force(spark, monkeypatch, most):
    """Also with joins that shuffle."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    docs = common.documents(spark, SF)
    states = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        states.append(common.materialize(stage(spark, states[-1], SF), name))
        assert states[-1].columns == docs.columns
    rows = [{r["doc_id"]: r for r in s.collect()} for s in states]

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert len(good ^ set(rows[1])) <= 2  # the fit sees the same rows, bins apart
    model = language.train(states[1], floors=True)
    found, cosines, classes = model.predict([r["text"] for r in rows[1].values()])
    assert set(rows[2]) == {i for i, x, y, k in zip(rows[1], found, cosines, classes) if x != "und" and y >= language.FLOOR * model.floors.get(k, 0)}
    assert len(rows[2]) >= 0.98 * len(rows[1])
    groups = by_hand([(i, r["text"]) for i, r in rows[2].items()])
    assert set(rows[3]) == {c for _, _, c in groups}
    assert {i: r["text"] for i, r in rows[4].items()} == {i: redacted(r["text"]) for i, r in rows[3].items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[4].values())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, states[-1], SF).collect()
    expected = Counter()
    for i, r in rows[4].items():
        ids = np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        bounds = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == expected
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in pieces])


def test_run_and_odd_rows(spark, docs, tmp_path):
    clean = docs.select("doc_id", "text", "lang", "source", "n_chars")
    path = f"file://{tmp_path}"
    clean.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    before = set(files.names_in(files.shared_dir(spark)))
    out = corpus_pipeline.run(spark, path)
    (left,) = set(files.names_in(files.shared_dir(spark))) - before
    assert left.startswith("eventide-best_fit_packing") and out.count() >= 0
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{path}/none/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0


def test_stage_copies(spark):
    rows = spark.createDataFrame([(5, "a b c d e f g", None), (3, "a b c d e f g", None), (3, "a b c d e f g", None), (9, "", None), (None, None, None)], "doc_id long, text string, lang string")
    assert sorted((r["doc_id"] or -1, r["text"]) for r in neardup.keep_one_of_each(rows).collect() if r["text"] is not None) == [(3, "a b c d e f g"), (9, "")]

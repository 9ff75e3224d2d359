"""Ids of other kinds of integers, and what queries leave behind."""

import os
import tracemalloc

import numpy as np
import pytest

from eventide.llm import language, media, neardup, packing, periodic, quality, registry, secrets, segmentation, token_store, vectors
from eventide.sources import files


@pytest.mark.parametrize("kind", ["int", "short"])
def test_ids_of_any_integer_kind(spark, docs, tmp_path, kind):
    docs = docs.where("length(text) < 50000 OR text IS NULL").withColumn("doc_id", docs["doc_id"].cast(kind))
    n = docs.count()
    labels = docs.selectExpr("doc_id", "1 AS quality").where("doc_id IS NOT NULL").union(docs.selectExpr("doc_id", "0 AS quality").limit(2))
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path)
    media.write_images(docs.select("doc_id", "text"), f"file://{tmp_path}/media")
    assert token_store.read_store(spark, path).count() == n and media.read_images(spark, f"file://{tmp_path}/media").count() == n
    assert language.identify(docs).count() == quality.score(docs, labels).count() == n
    assert secrets.find_spans(docs).count() == periodic.find_runs(docs).count() == n
    assert neardup.join_similar(docs).count() == n and segmentation.sample_segmentations(docs).count() >= n
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == {r["doc_id"] for r in docs.collect()}


def folders(base):
    return {n for n in os.listdir(base) if n.startswith("eventide-")}


@pytest.mark.parametrize("name", ["op3_secret_scans", "op12_exact_top_k", "op9_media_columns"])
def test_queries_leave_only_their_results(spark, name):
    base = files.place(files.shared_dir(spark))[1]
    before = folders(base)
    found = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    left = folders(base) - before
    assert len(left) == 1 and left.pop().startswith("eventide-result") and found.count() > 0
    assert registry.QUERIES[name].__name__ == name


def test_codebooks_take_little_memory():
    x = np.random.default_rng(0).normal(size=(40_000, 16))
    tracemalloc.start()
    words = vectors.codebook(x, 1024, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words.shape == (1024, 16) and peak < 150 << 20  # all distances at once are 330 MB
    near = ((x[:500, None, :] - words[None]) ** 2).sum(2)
    assert near.min(1).mean() < ((x[:500] - x.mean(0)) ** 2).sum(1).mean()

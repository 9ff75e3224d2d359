import sys
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventide.llm import common, packing, token_store
from eventide.llm.encoding import LONGEST_KEPT, TextEncoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name):
    """The library's ids for the given file, no setting changed: special tokens in a text have their own ids."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_words_give_the_ids_of_the_whole_text(name):
    encoder, whole = TextEncoder(public_tokenizers.path(name), cached_bytes=9000), plain(name)

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.sampled_from(list("abThE's.,!*|9 \n\t\x1c ́é😀İΣ\0<|>")), max_size=40))
    def same(text):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole(text)

    same()


def test_store_gives_the_ids_back(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path)
    got = token_store.read_store(spark, path).collect()
    encode = plain("word_bpe_49k.json")
    expected = [(r["doc_id"], encode(r["text"] or "") + [1]) for r in docs.collect()]
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted((i or -1, x) for i, x in expected)
    at = 0
    for row in sorted(got, key=lambda r: (r["start"], r["n_tokens"])):
        assert row["start"] == at
        at += row["n_tokens"]
    some = token_store.read_some(spark, path, [1, 7, 3, 404]).collect()
    whole = {(r["doc_id"], r["start"]): r["ids"] for r in got}
    assert sorted(r["doc_id"] for r in some) == [1, 3, 3, 7] and all(whole[r["doc_id"], r["start"]] == r["ids"] for r in some)
    ids = [r["doc_id"] or -1 for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)


def test_store_of_an_empty_table(spark, docs, tmp_path):
    token_store.write_store(docs.limit(0), f"file://{tmp_path}/none")
    assert token_store.read_store(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("shard_bytes", [token_store.SHARD_BYTES, 1000])
def test_rows_of_one_id_lie_in_several_shards(spark, tmp_path, shard_bytes):
    """A null id and one id have nearly all rows, some of which are equal; blocks are small, and with small shards there are more than shuffle partitions."""
    rows = [(None if k % 3 else 5, f"some text {k % 50} " * 20) for k in range(600)] + [(9, "last"), (-1, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/hot"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_store(docs, path, block_bytes=500, shard_bytes=shard_bytes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.select("shard").distinct().count() > (1 if shard_bytes > 1000 else 4) and blocks.groupBy("shard").count().where("count > 1").count()
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r["start"])
    assert [-9 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(-9 if i is None else i for i, _ in rows)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    encode = plain("word_bpe_49k.json")
    assert Counter((r["doc_id"], r["ids"]) for r in got) == Counter((i, np.array(encode(t) + [1], "<u4").tobytes()) for i, t in rows)
    assert token_store.read_some(spark, path, []).count() == 0 and token_store.read_some(spark, path, [9, -1, 77]).count() == 2


def test_whole_tables_by_the_library(spark):
    """op2 and op10 against one call of the library for each document."""
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    encode, expected, start = plain("word_bpe_49k.json"), {}, 0
    for i in sorted(texts):
        ids = np.array(encode(texts[i]) + [1], "<u4")
        expected[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.op2_token_id_output(spark, sf).collect()} == expected
    encode, expected = plain("byte_bpe_50k.json"), set()
    for i, text in texts.items():
        ids = np.array(encode(text) + [2], "<u4")
        bounds = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))}
    got = packing.op10_best_fit_packing(spark, sf).collect()
    assert len(got) == len(expected) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == expected
    used = check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    assert used <= 1.02 * sum(r["length"] for r in got) / 1024 + 2


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_packing_places_every_piece_once(spark, docs, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    got = packing.pack(docs).collect()
    encode = plain("byte_bpe_50k.json")
    expected = []
    for r in docs.collect():
        ids = encode(r["text"] or "") + [2]
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        expected += [(r["doc_id"] or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    assert packing.pack(docs.limit(0)).count() == 0


def check_sequences(rows):
    end = {}
    for sequence, offset, length in sorted(rows):
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
    assert max(end.values()) <= 1024
    return len(end)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 50)), max_size=20))
def test_plans_use_each_length_as_often_as_it_occurs(pairs):
    histogram = np.zeros(65, np.int64)
    for length, n in pairs:
        histogram[length] += n
    used = np.zeros_like(histogram)
    total = 0
    for pattern, count in packing.plan_patterns(histogram, 64):
        assert sum(pattern) <= 64
        total += count
        for length in pattern:
            used[length] += count
    assert (used == histogram).all()
    assert total <= 1.25 * -(-int((histogram * np.arange(65)).sum()) // 64) + 2 + histogram[33:].sum()


def test_near_the_least_number_of_sequences():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 1025, 50_000), minlength=1025)
    least = -(-int((histogram * np.arange(1025)).sum()) // 1024)
    assert sum(count for _, count in packing.plan_patterns(histogram, 1024)) <= 1.02 * least


@pytest.mark.parametrize("name", FILES)
def test_special_tokens_in_texts_keep_their_ids(name):
    encoder, whole = TextEncoder(public_tokenizers.path(name), cached_bytes=9000), plain(name)
    assert np.frombuffer(encoder.encode("one <|endoftext|> two"), "<u4").tolist() == {"byte_bpe_50k.json": [505, 220, 50256, 734], "word_bpe_49k.json": [637, 49407, 1237]}[name]

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", *"abThE's.,!*|9 \n\t\x1c ́é😀İΣ\0<|>"]), max_size=20).map("".join))
    def same(text):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole(text)

    same()


def test_stored_and_packed_special_tokens(spark, tmp_path):
    texts = ["one <|endoftext|> two", "<|startoftext|>a<|endoftext|>.", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_store.write_store(docs, f"file://{tmp_path}/store")
    stored = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.read_store(spark, f"file://{tmp_path}/store").collect()}
    assert stored == {i: plain("word_bpe_49k.json")(text) + [1] for i, text in enumerate(texts)}
    packed = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(docs).collect()}
    whole = {i: np.array(plain("byte_bpe_50k.json")(text) + [2], "<u4") for i, text in enumerate(texts)}
    assert packed == {i: (len(ids), zlib.crc32(ids.tobytes())) for i, ids in whole.items()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_very_long_words_are_not_kept(name):
    """What a worker keeps is bounded in bytes, whatever the words: minified code and base64 have words of any length."""
    encoder, whole = TextEncoder(public_tokenizers.path(name), cached_bytes=200_000), plain(name)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefXYZ019+/=.", k=rng.choice([3, 200, 300, 20_000]))) for _ in range(4)) for _ in range(60)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole(text)
        for words in (encoder.bare, encoder.spaced):
            assert sum(sys.getsizeof(w) + sys.getsizeof(x) for w, x in words.items()) <= words.held <= 200_000 and max(map(len, words), default=0) <= LONGEST_KEPT

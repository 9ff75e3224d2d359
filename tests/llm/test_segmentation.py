from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from eventide.llm import segmentation as seg

PATH = public_tokenizers.path("piece_bpe_32k.model")


def every_segmentation(vocab, text):
    """All paths and their probabilities, by plain recursion."""
    known = {vocab.texts[k]: k for k in vocab.normal}
    marked = seg.BLANK + text.replace(" ", seg.BLANK)

    def paths(at):
        if at == len(marked):
            yield (), 0.0
            return
        if marked[at] not in known:
            raw = marked[at].encode()
            for rest, s in paths(at + 1):
                yield tuple(vocab.bytes[b] for b in raw) + rest, vocab.rare * len(raw) + s
        for n in range(1, min(vocab.longest, len(marked) - at) + 1):
            if (piece := known.get(marked[at : at + n])) is not None:
                for rest, s in paths(at + n):
                    yield (piece, *rest), float(vocab.score[piece]) + s

    found = dict(paths(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: v - total for k, v in found.items()}


@pytest.mark.parametrize("text", ["the cat", "a  é亜 b", " x ", "hello\nyou"])
def test_probabilities_and_distinct_samples(text):
    vocab = seg.vocabulary(PATH)
    every = every_segmentation(vocab, text)
    search = seg.Search(vocab, [text] * 50, np.arange(50, dtype=np.uint64) * 977, 4)
    got = {}
    for d, k, ids, log_prob, perturbed, inclusion in search.found():
        assert abs(every[tuple(ids.tolist())] - log_prob) < 1e-6
        got.setdefault(d, []).append((tuple(ids.tolist()), perturbed, inclusion))
        assert vocab.decode(ids).decode() == text
    for drawn in got.values():
        assert len({x[0] for x in drawn}) == len(drawn) == min(4, len(every))
        assert [x[1] for x in drawn] == sorted((x[1] for x in drawn), reverse=True) and all(x[2] <= 0 for x in drawn)


def test_all_segmentations_of_a_short_text():
    vocab = seg.vocabulary(PATH)
    every = every_segmentation(vocab, "ab")
    got = [(tuple(ids.tolist()), inclusion) for *_, ids, _, _, inclusion in [(0, 0, *x[2:]) for x in seg.Search(vocab, ["ab"], np.array([5], np.uint64), 50).found()]]
    assert sorted(x[0] for x in got) == sorted(every) and all(x[1] == 0 for x in got)


def test_frequencies_of_draws_without_replacement():
    vocab = seg.vocabulary(PATH)
    every = every_segmentation(vocab, "then in")
    n = 20_000
    search = seg.Search(vocab, ["then in"] * n, np.random.default_rng(1).integers(0, 2**63, n, dtype=np.uint64), 2)
    first, second, weight = Counter(), Counter(), Counter()
    for _, k, ids, log_prob, _, inclusion in search.found():
        (second if k else first)[tuple(ids.tolist())] += 1
        weight[tuple(ids.tolist())] += np.exp(log_prob - inclusion)
    p = {s: np.exp(v) for s, v in every.items()}
    for s in sorted(p, key=p.get)[-8:]:
        assert abs(first[s] / n - p[s]) < 5 * np.sqrt(p[s] / n) + 1e-3
        as_second = sum(p[t] * p[s] / (1 - p[t]) for t in p if t != s)
        assert abs(second[s] / n - as_second) < 5 * np.sqrt(as_second / n) + 1e-3
        assert abs(weight[s] / n - p[s]) < 0.2 * p[s] + 5e-3  # importance weights estimate the probabilities


def test_rows(spark, docs):
    got = seg.sample_segmentations(docs, samples=3).collect()
    by_id = {}
    for r in got:
        assert r["decoded"] and r["log_inclusion"] <= 0
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[2][0]["ids"] == [] and len(by_id[3]) == 2 and len(by_id[1]) == 3
    again = seg.sample_segmentations(docs.repartition(5), samples=3).collect()
    key = lambda r: (r["doc_id"] or -1, r["sample"], r["ids"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in seg.decode_ids(seg.sample_segmentations(docs)).collect():
        assert r["text"] == (texts[r["doc_id"]] or "")
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in got[:10]:
        assert reference.decode(r["ids"]) == (texts[r["doc_id"]] or "")
    assert seg.sample_segmentations(docs.limit(0)).count() == 0

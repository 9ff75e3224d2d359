"""License scans over a positional rare-token index.

The words of licence templates are indexed with the template and the relative position at which they
stand. A file looks up those licence words of mandatory key phrases that it holds, from the rarest on (by inverse document
frequency over all documents). Each occurrence of a word and posting of it says where the template would begin;
the places that ``ANCHORS`` words of a template agree on are the intersection of their postings by relative position. There the
key phrase must stand word for word. The share of the template's words found at such a place is the score.

The words that are intersected belong to the template's own key phrase, and only templates are asked for whose key
words the file holds, so none is missed: rare words only come first because they give the fewest places.

Whole licence texts have an index of all of their words. Of a file's licence words the rarest ``WHOLE_ANCHORS`` that a text has are looked
up, and their postings intersected by relative position: the text is found at the places on which at least ``AGREE`` of them (all, if there are fewer)
agree and where its key phrase stands. ``whole_labels`` names the texts of which at least ``WHOLE_SHARE`` of the words stand where they should, and
``whole_share`` is the largest share of any that was found.

Defined cases: a null or empty text has no words and no label; a null doc_id and repeated rows are
documents like any other; words of equal frequency are looked up in the order of their letters, which changes no result;
of several places of templates the best share is the score; texts of any length are scanned whole; other columns are
not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_texts import WHOLE


@dataclass(frozen=True)
class Template:
    """key: the words that must stand one after the other, somewhere in text."""

    label: str
    text: str
    key: str


# Phrases that count as base places, with their labels.
BASE = (
    Template("cc-by", "cc by", "cc by"),
    Template("gpl", "general public license", "general public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)
# Sentences and notices by which well-known licences are recognised.
MORE = (
    Template("agpl-3.0", "gnu affero general public license version 3", "affero general public license"),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache license version 2 0",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms",
    ),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("epl-2.0", "eclipse public license v 2 0", "eclipse public license"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
        "under the terms of the gnu general public license",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software",
    ),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge",
    ),
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mozilla public license",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software",
    ),
)
TEMPLATES = BASE + MORE


def _find(words: list[bytes], part: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


#: Bytes that are no part of a word become blanks, and A-Z lower case; all other bytes stay.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


#: Rare words of a key phrase whose postings are intersected.
ANCHORS = 3


class TemplateIndex:
    """Postings of the templates' words, and the frequencies that order the look-ups."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, frequency: dict[bytes, int] | None = None) -> None:
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.keys = [words_of(t.key) for t in templates]
        self.key_at = [_find(w, k) for w, k in zip(self.words, self.keys, strict=True)]
        self.key_sets = [set(k) for k in self.keys]
        self.vocabulary = frozenset(w for k in self.keys for w in k)
        #: word: template: the positions in the template, from the key phrase's
        self.postings: dict[bytes, dict[int, list[int]]] = {w: {} for w in self.vocabulary}
        for t, (key, at) in enumerate(zip(self.keys, self.key_at, strict=True)):
            for r, word in enumerate(key):
                self.postings[word].setdefault(t, []).append(at + r)
        frequency = frequency or {}
        self.order = {w: (frequency.get(w, 0), w) for w in self.vocabulary}
        #: every key phrase holds one of these: a file without them holds no template
        self.anchors = frozenset(min(k, key=self.order.__getitem__) for k in self.keys)

    def tops(self, words: list[bytes], present: set[bytes]) -> dict[int, set[int]]:
        """For each template the places at which it would begin, by all of its ANCHORS rarest words of the key phrase."""
        wanted = {t: ANCHORS for t, key in enumerate(self.key_sets) if key <= present}
        found: dict[int, set[int]] = {}
        for word in sorted(present & self.vocabulary, key=self.order.__getitem__):
            here = [(t, places) for t, places in self.postings[word].items() if wanted.get(t)]
            if not here:
                continue
            at = list(_positions(words, word))
            for t, places in here:
                tops = {p - r for r in places for p in at}
                found[t] = found[t] & tops if t in found else tops
                wanted[t] = wanted[t] - 1 if found[t] else 0
        return found

    def places(self, words: list[bytes], present: set[bytes]) -> dict[int, dict[int, float]]:
        """For each template the places of its key phrase, with the share of the template's words there."""
        found: dict[int, dict[int, float]] = {}
        for t, tops in self.tops(words, present).items():
            key, at, text = self.keys[t], self.key_at[t], self.words[t]
            for top in tops:
                if top + at >= 0 and words[top + at : top + at + len(key)] == key:
                    hits = sum(1 for i, w in enumerate(text) if 0 <= top + i < len(words) and words[top + i] == w)
                    found.setdefault(t, {})[top + at] = hits / len(text)
        return found


#: Rare words that are looked up for a whole text, those that have to agree on its place, and the share of its words that makes it whole.
WHOLE_ANCHORS, AGREE, WHOLE_SHARE = 8, 3, 0.8
WHOLE_TEMPLATES = tuple(Template(*x) for x in WHOLE)


class WholeIndex(TemplateIndex):
    """Postings of all words of whole texts."""

    def __init__(self, templates: tuple[Template, ...] = WHOLE_TEMPLATES, frequency: dict[bytes, int] | None = None) -> None:
        super().__init__(templates, frequency)
        self.vocabulary = frozenset(w for words in self.words for w in words)
        self.postings = {w: {} for w in self.vocabulary}
        for t, words in enumerate(self.words):
            for r, word in enumerate(words):
                self.postings[word].setdefault(t, []).append(r)
        self.order = {w: ((frequency or {}).get(w, 0), w) for w in self.vocabulary}
        #: the rarest word of each key phrase: a file without them holds no text
        self.anchors = frozenset(min(k, key=self.order.__getitem__) for k in self.keys)

    def tops(self, words: list[bytes], present: set[bytes]) -> dict[int, set[int]]:
        """For each text the places at which it would begin, by AGREE of its WHOLE_ANCHORS rarest words that the file holds."""
        wanted = {t: WHOLE_ANCHORS for t, key in enumerate(self.key_sets) if key <= present}
        votes: dict[int, Counter[int]] = {}
        for word in sorted(present & self.vocabulary, key=self.order.__getitem__) if wanted else ():
            here = [(t, places) for t, places in self.postings[word].items() if wanted.get(t)]
            if not here:
                continue
            at = list(_positions(words, word))
            for t, places in here:
                votes.setdefault(t, Counter()).update({p - r for r in places for p in at})
                wanted[t] -= 1
        return {t: {top for top, n in found.items() if n >= min(AGREE, WHOLE_ANCHORS - wanted[t])} for t, found in votes.items()}


def _positions(words: list[bytes], word: bytes) -> Iterator[int]:
    at = -1
    try:
        while True:
            at = words.index(word, at + 1)
            yield at
    except ValueError:
        return


def frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, int]:
    """In how many documents each word of the key phrases and of the whole texts occurs; a row per such word comes to the driver."""
    vocabulary = TemplateIndex(templates).vocabulary | WholeIndex().vocabulary

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in common.slices(batches, 512):
            for text in batch["text"].to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(common.text_column().alias("text")).mapInArrow(task, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, whole_labels string, whole_share double"


def scan(docs: DataFrame, templates: tuple[Template, ...] = MORE) -> DataFrame:
    """Per document the base places and labels, all labels, and the best share of a template that was found."""
    every = BASE + templates
    frequency = frequencies(docs, every)
    n_base = len(BASE)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, whole = TemplateIndex(every, frequency), WholeIndex(frequency=frequency)
        both = index.vocabulary | whole.vocabulary
        for batch in common.slices(batches, 512):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                present = both.intersection(words)
                found = index.places(words, present) if present & index.anchors else {}
                shares = [(max(places.values()), whole.templates[t].label) for t, places in whole.places(words, present).items()] if present & whole.anchors else []
                base = [p for t, places in found.items() if t < n_base for p in places]
                labels = [sorted({every[t].label for t in found if t < most}) for most in (n_base, len(every))]
                rows.append((doc_id, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(labels[0]), ",".join(labels[1]), max((s for places in found.values() for s in places.values()), default=0.0), ",".join(sorted({x for s, x in shares if s >= WHOLE_SHARE})), max((s for s, _ in shares), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select("doc_id", common.text_column().alias("text")).mapInArrow(task, RESULT)


KINDS = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.float64()]


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def _oracle() -> str:
    def listed(words: list[bytes]) -> str:
        return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"

    index = TemplateIndex()
    rows = ", ".join(f"({t}, '{x.label}', {t < len(BASE)}, {listed(index.words[t])}, {listed(index.keys[t])}, {index.key_at[t]})" for t, x in enumerate(TEMPLATES))
    whole = WholeIndex()
    texts = ", ".join(f"({t}, '{x.label}', {listed(whole.words[t])}, {listed(whole.keys[t])}, {whole.key_at[t]})" for t, x in enumerate(WHOLE_TEMPLATES))
    letters = "".join(map(chr, range(65, 91)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) v(t, label, base, words, phrase, phrase_at)),
f AS (SELECT row_id, label, base, words, phrase_at, w, unnest(list_filter(range(len(w) - len(phrase) + 1), lambda p: w[p + 1 : p + len(phrase)] = phrase)) AS p FROM d, t WHERE list_has_all(w, phrase)),
s AS (SELECT row_id, label, base, p, len(list_filter(range(len(words)), lambda i: p - phrase_at + i >= 0 AND w[p - phrase_at + i + 1] = words[i + 1])) / len(words) AS share FROM f),
a AS (SELECT row_id, count(*) FILTER (WHERE base) AS n_base, min(p) FILTER (WHERE base) AS first_word, max(p) FILTER (WHERE base) AS last_word,
      array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM s GROUP BY row_id),
x AS (SELECT * FROM (VALUES {texts}) v(t, label, words, phrase, phrase_at)),
y AS (SELECT t, unnest(words) AS word, unnest(range(len(words))) AS r FROM x),
q AS MATERIALIZED (SELECT * FROM (SELECT row_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d) WHERE word IN (SELECT word FROM y)),
i AS (SELECT word, count(DISTINCT row_id) AS df FROM q GROUP BY word),
c AS (SELECT row_id, t FROM d, x WHERE list_has_all(w, phrase)),
b AS (SELECT * FROM (SELECT c.row_id, c.t, u.word, row_number() OVER (PARTITION BY c.row_id, c.t ORDER BY i.df, u.word) AS k, count(*) OVER (PARTITION BY c.row_id, c.t) AS n
      FROM c JOIN (SELECT DISTINCT t, word FROM y) u ON u.t = c.t JOIN (SELECT DISTINCT row_id, word FROM q) o ON o.row_id = c.row_id AND o.word = u.word JOIN i ON i.word = u.word) WHERE k <= {WHOLE_ANCHORS}),
g AS (SELECT row_id, t, n, top FROM (SELECT DISTINCT b.row_id, b.t, b.n, b.word, q.p - y.r AS top FROM b JOIN q ON q.row_id = b.row_id AND q.word = b.word JOIN y ON y.t = b.t AND y.word = b.word) GROUP BY ALL HAVING count(*) >= least({AGREE}, least(n, {WHOLE_ANCHORS}))),
h AS (SELECT g.row_id, x.label, len(list_filter(range(len(x.words)), lambda i: top + i >= 0 AND d.w[top + i + 1] = x.words[i + 1])) / len(x.words) AS share
      FROM g JOIN x ON x.t = g.t JOIN d ON d.row_id = g.row_id WHERE top + phrase_at >= 0 AND CASE WHEN top + phrase_at >= 0 THEN d.w[top + phrase_at + 1 : top + phrase_at + len(phrase)] = phrase END),
z AS (SELECT row_id, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE share >= {WHOLE_SHARE})), ',') AS whole_labels, max(share) AS whole_share FROM h GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score,
       coalesce(whole_labels, '') AS whole_labels, CAST(coalesce(whole_share, 0) AS DOUBLE) AS whole_share
FROM d LEFT JOIN a USING (row_id) LEFT JOIN z USING (row_id)"""


ORACLE = _oracle()

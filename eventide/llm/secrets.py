"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean trigram query. One pass over the texts finds those of
the queries' trigrams that a text holds; they are the postings (trigram, document), which are written
as a table. Intersecting the postings by each query leaves the candidates, whose texts alone are searched with
the rule itself. A rule that has no mandatory trigram searches every text. Texts that are certainly no candidates
are told apart by a bitmap of a fixed size, so only the others meet the table of candidates.

Positions count code points; they are running sums, over the matches of a text, of the lengths of the matches and of what lies between, so a
text costs time in proportion to its length and its matches. Rules do not match the empty text, and do not name the characters ``MARK`` and ``OTHER``.

Defined cases: a null or empty text has no span; a null doc_id is a document like any other; rows that
repeat give equal results, each its own; any text length is searched whole; spans that begin at one place come in the
order of the rules; columns other than doc_id and text are kept only by ``redact`` and ``find_spans``, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .trigrams import Clause, thinned, trigram_query

#: Trigrams that the index holds for each string that a rule demands.
GRAMS = 2


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches; those with a shorter group than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def query(self) -> list[Clause]:
        """Its trigram query; empty: there is no mandatory trigram."""
        return thinned(trigram_query(self.pattern), GRAMS)


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Well-known credential formats; they add spans of their own kinds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<start:int,kind:int,stop:int>>"
STEPS = "array<struct<kind:int,place:int,gap:int,width:int,counts:boolean>>"
CUTS = "array<struct<start:int,stop:int>>"
#: A private character that is set around matches, and its like that stands for it where a text holds it; and code points of a block of a text.
MARK, OTHER, BLOCK = "\ue000", "\ue001", 1000


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings: gram, doc_id, digest, for the trigrams that the rules' queries name."""
    grams = sorted({g for rule in rules for clause in rule.query for s in clause for g in s})
    low = docs.select("doc_id", "digest", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc_id", "digest", F.explode(held).alias("gram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, digest, and for each rule with a query whether the document satisfies it."""
    held = postings.groupBy("doc_id", "digest").agg(F.collect_set("gram").alias("grams"))

    def satisfied(rule: Rule) -> Column:
        has = lambda s: reduce(Column.__and__, [F.array_contains("grams", g) for g in sorted(s)])
        return reduce(Column.__and__, [reduce(Column.__or__, map(has, clause)) for clause in rule.query])

    wanted = {f"may_{rule.kind}": satisfied(rule) for rule in rules if rule.query}
    some = held.select("doc_id", "digest", *[c.alias(name) for name, c in wanted.items()])
    return some.where(reduce(Column.__or__, map(F.col, wanted)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """The expression over a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rule_steps(rule: Rule, kind: int, text: Column) -> Column:
    """The rule's matches in a text, in order: their number, the length of what lies before each, its own, and whether it counts.

    One pass over the text sets marks around the matches; a mark that the text holds itself is replaced by its like before, of the same length.
    """
    marked_text = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), F.lit(rule.pattern), F.lit(f"{MARK}$0{MARK}"))
    pieces = F.split(marked_text, MARK, -1)
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.lit(None).cast("array<string>")

    def steps(both: Column) -> Column:
        matches = F.filter(both["pieces"], lambda _, k: k % 2 == 1)
        counted = lambda match, k: F.length(F.get(both["part"], k) if rule.group else match) >= rule.least
        return F.transform(matches, lambda match, k: F.struct(F.lit(kind).alias("kind"), k.alias("place"), F.length(F.get(both["pieces"], 2 * k)).alias("gap"), F.length(match).alias("width"), counted(match, k).alias("counts")))

    return once(F.struct(pieces.alias("pieces"), part.alias("part")), steps)


def span_table(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, digest, spans (all, by start, then in the order of the rules) and cuts (start and stop of overlapping ones together), for texts that have spans.

    texts: doc_id, digest, text, and a boolean ``may_<kind>`` for each rule that is to be searched for only where it holds. Places are running sums
    over the matches of a text, so the work is in proportion to their number.
    """

    def searched(k: int, rule: Rule) -> Column:
        steps = rule_steps(rule, k, F.col("text"))
        return F.when(F.coalesce(F.col(f"may_{rule.kind}"), F.lit(False)), steps).otherwise(F.array().cast(STEPS)) if f"may_{rule.kind}" in texts.columns else steps

    found = texts.select("doc_id", "digest", F.inline(F.concat(*[searched(k, rule) for k, rule in enumerate(rules)])))
    found = found.groupBy("doc_id", "digest", "kind", "place").agg(*[F.first(c).alias(c) for c in ("gap", "width", "counts")])  # repeated rows have the same
    of_kind = Window.partitionBy("doc_id", "digest", "kind").orderBy("place")
    placed = found.withColumn("stop", F.sum(F.col("gap") + F.col("width")).over(of_kind).cast("int")).where("counts")
    spans = placed.select("doc_id", "digest", (F.col("stop") - F.col("width")).alias("start"), "kind", "stop")
    before = Window.partitionBy("doc_id", "digest").orderBy("start", "kind")
    reached = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("begins", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    numbered = begins.withColumn("cut", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    by_cut = numbered.groupBy("doc_id", "digest", "cut").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_list(F.struct("start", "kind", "stop")).alias("spans"))
    return by_cut.groupBy("doc_id", "digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))


def searched_rows(docs: DataFrame, rules: tuple[Rule, ...], spans: str, cuts: str) -> DataFrame:
    """The rows with two more columns: all rules' spans, and the cuts that they make."""
    digest, doc, flag = (common.free_name([*docs.columns, spans, cuts], f"_secret_{n}") for n in ("digest", "doc", "flag"))
    rows = docs.withColumns({doc: F.col("doc_id"), digest: F.xxhash64(common.text_column())})
    keyed = rows.select("doc_id", F.col(digest).alias("digest"), common.text_column().alias("text"))
    postings = common.materialize(index(keyed, rules), "postings")
    found = common.materialize(candidates(postings, rules), "candidates")
    held = common.marked(keyed, found.select(F.col("doc_id").alias("doc_id"), "digest"), ["doc_id", "digest"], "near")
    other = found.withColumnsRenamed({"doc_id": "found_doc", "digest": "found_digest"})
    met = held.where("near").join(other, F.col("doc_id").eqNullSafe(F.col("found_doc")) & (F.col("digest") == F.col("found_digest")), "left")
    if any(not rule.query for rule in rules):  # these are searched for in every text
        far = held.where("NOT near")
        met = met.unionByName(far, allowMissingColumns=True)
    table = common.materialize(span_table(met, rules), "spans")
    table = table.select(F.col("doc_id").alias(f"{doc}_"), F.col("digest").alias(f"{digest}_"), F.col("spans").alias(spans), F.col("cuts").alias(cuts))
    marked = common.marked(rows, table.select(F.col(f"{doc}_").alias(doc), F.col(f"{digest}_").alias(digest)), [doc, digest], flag)
    near = marked.where(flag).join(table, F.col(doc).eqNullSafe(F.col(f"{doc}_")) & (F.col(digest) == F.col(f"{digest}_")), "left")
    none = {spans: F.array().cast(SPAN), cuts: F.array().cast(CUTS)}
    far = marked.where(~F.col(flag)).select(*docs.columns, *[c.alias(name) for name, c in none.items()])
    return far.union(near.select(*docs.columns, *[F.coalesce(name, c).alias(name) for name, c in none.items()]))


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "secret_spans") -> DataFrame:
    """The rows with one more column: all rules' spans, by start, then in the order of the rules."""
    cuts = common.free_name([*docs.columns, column], "secret_cuts")
    return searched_rows(docs, rules, column, cuts).drop(cuts)


def joined_spans(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:stop of each span, comma-joined."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def without(text: Column, cuts: Column, mark: str) -> Column:
    """The text with a mark in place of each cut. Pieces are taken from blocks of the text, as a place in a long text is only found by counting."""

    def pieces(blocks: Column) -> Column:
        def piece(start: Column, stop: Column) -> Column:
            first, last = F.floor(start / BLOCK).cast("int"), F.floor(stop / BLOCK).cast("int")
            block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
            inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            across = F.concat(F.substring(block(first), start % BLOCK + 1, F.lit(BLOCK)), inner, F.substring(block(last), F.lit(1), stop % BLOCK))
            return F.when(first == last, F.substring(block(first), start % BLOCK + 1, stop - start)).otherwise(across)

        starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["stop"]))
        stops = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.length(text)))
        return F.array_join(F.zip_with(starts, stops, piece), mark)

    return once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), pieces)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every secret (overlapping ones together) replaced by a mark, and n_chars set anew where it was known."""
    spans = common.free_name(docs.columns, "secret_spans")
    cuts = common.free_name([*docs.columns, spans], "secret_cuts")
    found = searched_rows(docs, rules, spans, cuts)
    has = F.size(cuts) > 0
    out = found.withColumn("text", F.when(has, without(F.col("text"), F.col(cuts), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(common.documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE_RULES))
    of_kind = lambda k: F.filter("secret_spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("secret_spans")).alias("spans"))


def _oracle() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    parts = [
        f"SELECT row_id, {k} AS kind, '{rule.kind}' AS name, string_split_regex(text, {quoted(rule.pattern)}) AS gaps, regexp_extract_all(text, {quoted(rule.pattern)}, 0) AS found, regexp_extract_all(text, {quoted(rule.pattern)}, {rule.group}) AS parts, {rule.least} AS least FROM d WHERE regexp_matches(text, {quoted(rule.pattern)})"
        for k, rule in enumerate(RULES)
    ]
    text = "kind_name || ':' || start || ':' || stop, ',' ORDER BY start, kind"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{rule.kind}" for k, rule in enumerate(BASE_RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
n AS (SELECT row_id, kind, name, gaps, found, parts, least, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT row_id, kind, name AS kind_name, i, length(parts[i]) >= least AS good, length(found[i]) AS width,
      sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY row_id, kind ORDER BY i) AS stop FROM n),
p AS (SELECT row_id, kind, kind_name, CAST(stop - width AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE good),
a AS (SELECT row_id, {counts}, string_agg({text}) FILTER (WHERE kind < {len(BASE_RULES)}) AS base, string_agg({text}) AS spans FROM p GROUP BY row_id)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{rule.kind}, 0) AS BIGINT) AS n_{rule.kind}" for rule in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row_id)"""


ORACLE = _oracle()

"""The corpus pipeline: quality, language, near copies, secrets, packing.

Each stage works on all rows that its predecessor kept. Quality and language drop the documents that they
reject, the near-copy stage keeps one document of each group, the secret stage replaces the secrets it
finds, and packing returns a row per piece. Stages are written as Parquet to the shared folder and read again; what
a stage has written on its way, and its input, are deleted once its result is there.

Defined cases: a null text counts as empty: quality scores it, and the language stage drops it, as any text without a letter; null ids,
repeated ids and repeated rows are rows like any other, of which the near-copy stage keeps one of each group of
copies; texts of any length go through whole; n_chars follows what the secret stage replaces; other columns are kept by all
stages but the last; without a labelled row to learn from, all documents pass the quality stage; without a language to learn, texts with letters stay; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import common, language, neardup, packing, quality, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifiers nor the tokenizer; tests/llm compares with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = common.documents(spark, sf_dir)
    with common.scratch(spark) as written:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""Keyed de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tasks among which the rows of one key are dealt.
SPREAD = 8


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the first by the given order, or by arrival. Rows whose key is null all stay.

    Rows are dealt by key first, so that a task sorts what a shuffle gives it and not a whole file; a key's rows go to ``SPREAD`` tasks, whose
    aggregates combine the copies of a frequent key before the last shuffle. The rows are read once.
    """
    arrival = F.monotonically_increasing_id()
    at = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)]) if order else arrival
    alone = F.when(F.col(key).isNull(), arrival)
    packed = rows.select(F.col(key).alias("key"), alone.alias("alone"), F.struct(*rows.columns).alias("row"), at.alias("at"))
    dealt = packed.withColumn("part", F.pmod(arrival, F.lit(SPREAD))).repartition("key", "alone", "part").drop("part")
    return dealt.groupBy("key", "alone").agg(F.min_by("row", "at").alias("row")).select("row.*")


def new_keys(rows: DataFrame, held: DataFrame, key: str, held_key: str | None = None) -> DataFrame:
    """The rows whose key the held rows lack. Both are shuffled: the keys are narrow in their file, but too many to be broadcast."""
    keys = held.select(F.col(held_key or key).alias("_held_key")).hint("merge")
    return rows.join(keys, F.col(key) == F.col("_held_key"), "left_anti")

"""Two streams joined over an interval of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed_by(causes: DataFrame, effects: DataFrame, keys: list[str], time: str, within: str, late: str) -> DataFrame:
    """Each row of one stream with the rows of another that have its keys and come at most ``within`` after it, as columns ``cause`` and ``effect``.

    Rows may come ``late`` by event time. A row is kept in the state until the watermark says that no partner can come any more: effects as long as
    causes may be late, causes for the interval longer. Frames that are no streams give the same pairs. Null keys and times match nothing.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        named = [F.col(k).alias(f"{name}_key{n}") for n, k in enumerate(keys)]
        packed = rows.select(F.col(time).alias(f"{name}_at"), *named, F.struct(*rows.columns).alias(name))
        return packed.withWatermark(f"{name}_at", late)

    same = F.lit(True)
    for n in range(len(keys)):
        same &= F.col(f"cause_key{n}") == F.col(f"effect_key{n}")
    soon = F.expr(f"effect_at >= cause_at AND effect_at <= cause_at + INTERVAL {within}")
    return side(causes, "cause").join(side(effects, "effect"), same & soon).select("cause", "effect")

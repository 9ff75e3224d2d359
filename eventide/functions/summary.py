"""Numbers as people read them, as columns, and a structured summary of a result."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts are scaled by, largest first.
SCALES = ((1_000_000, "M"), (1_000, "K"))


def short_count(n: str | Column, scales: tuple[tuple[int, str], ...] = SCALES) -> Column:
    """A count with one decimal and a letter from a thousand on."""
    count = F.col(n) if isinstance(n, str) else n
    text = count.cast("string")
    for size, letter in reversed(scales):
        text = F.when(count >= size, F.format_string(f"%.1f{letter}", count / F.lit(float(size)))).otherwise(text)
    return text


def percentage(part: str | Column, total: str | Column) -> Column:
    """The part's percentage of the total with one decimal; of nothing, zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (part, total))
    return F.when(b == 0, F.lit("0%")).otherwise(F.format_string("%.1f%%", a * F.lit(100.0) / b))


def summarize(rows: list[dict[str, Any]], error: str | None = None) -> dict[str, Any]:
    """What a model or a log needs to know of a query's outcome."""
    if error is not None:
        return {"ok": False, "error": error}
    return {"ok": True, "rows": len(rows), "columns": list(rows[0]) if rows else [], "first": rows[0] if rows else None}

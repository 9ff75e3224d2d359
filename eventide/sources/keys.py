"""Bloom filters of the keys of segments, as tables beside them.

A key's hash chooses a slot of 4 KiB, and ``BITS`` more hashes a bit each in it, so one row of a filter answers for a key. A
slot holds about a thousand keys, at which about 6 in a million keys that are not there seem to be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_BITS, PER_SLOT, BITS = 32_768, 1024, 8
#: Slots of which one task builds the bits; it sorts up to ``BITS`` rows of two numbers for each of their keys.
TASK_SLOTS = 256
FILTER = "segment string, slots int, slot int, bits binary"


def slots_for(keys: int) -> int:
    """The number of slots for so many keys, a power of two."""
    return 1 << max(0, -(-keys // PER_SLOT) - 1).bit_length() if keys else 0


def _slot(key: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(key), slots).cast("int")


def _bit(key: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k)), F.lit(SLOT_BITS))


def key_filter(keys: DataFrame, segment: str, slots: int) -> DataFrame:
    """The filter of a frame of one column, ``key``. Keys are dealt by slot before they become bits, so what a task sorts does not grow with the segment."""
    dealt = keys.where("key IS NOT NULL").select("key", _slot(F.col("key"), F.lit(slots)).alias("slot")).repartition(-(-slots // TASK_SLOTS), "slot")
    spread = dealt.select("slot", F.explode(F.array(*[_bit(F.col("key"), k) for k in range(BITS)])).alias("bit"))
    bits = spread.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return bits.select(F.lit(segment).alias("segment"), F.lit(slots).alias("slots"), "slot", "bits")


def segments_with(keys: DataFrame, filters: DataFrame, sizes: list[int]) -> list[str]:
    """The segments whose filters may hold one of the keys. sizes: the numbers of slots that the filters have."""

    def is_set(k: int) -> Column:
        place = _bit(F.col("key"), k).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, place % 8) == 1

    asked = keys.where("key IS NOT NULL").select("key", F.explode(F.lit(sizes)).alias("asked"))
    asked = asked.withColumn("place", _slot(F.col("key"), F.col("asked"))).hint("merge")  # by their size in the file they would be broadcast
    met = asked.join(filters, (F.col("asked") == F.col("slots")) & (F.col("place") == F.col("slot")))
    return [r["segment"] for r in met.where(reduce(Column.__and__, map(is_set, range(BITS)))).select("segment").distinct().collect()]

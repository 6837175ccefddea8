"""Rows of a wide table that a join on few keys need not move.

Hashes of the keys set bits in a bitmap that goes to every task. A row whose bit
is not set has none of the keys and stays where it is; the others are left to an
exact join. The bitmap has ``BITS_PER_KEY`` bits for each key and ``MOST_BITS``
at most: beyond that more rows are taken for possible ones, and none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.plans.scratch import row_count

BITS_PER_KEY = 16
MOST_BITS = 1 << 26  # 8 MB
_SEGMENT_BITS = 15  # bitmap_construct_agg fills 4096 bytes


def bitmap_bits(keys: int) -> int:
    """Bits for so many keys: a power of two of whole segments."""
    wanted = min(max(BITS_PER_KEY * keys, 1 << _SEGMENT_BITS), MOST_BITS)
    return 1 << (wanted - 1).bit_length()


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame, of: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose hash ``key`` can be among the hashes ``of`` the rows of ``keys``, and those whose hash is not.

    Both hashes are longs and never null. Every row of ``df`` is in one of the two tables.
    """
    bits = F.lit(bitmap_bits(row_count(keys)))
    within = F.lit((1 << _SEGMENT_BITS) - 1)
    slots = keys.select(F.pmod(of, bits).alias("slot"))
    segments = slots.groupBy(F.shiftright("slot", _SEGMENT_BITS).alias("_segment")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(within)).alias("_bits"))
    rows = df.select(F.struct("*").alias("_row"), F.pmod(key, bits).alias("_slot")).withColumn(
        "_segment", F.shiftright("_slot", _SEGMENT_BITS))
    octet = F.conv(F.hex(F.expr(f"substring(_bits, int((_slot & {(1 << _SEGMENT_BITS) - 1}) div 8) + 1, 1)")), 16, 10).cast("int")
    there = F.coalesce(F.getbit(octet, F.col("_slot").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    marked = rows.join(F.broadcast(segments), "_segment", "left").select("_row", there.alias("_there"))
    return marked.filter("_there").select("_row.*"), marked.filter("not _there").select("_row.*")

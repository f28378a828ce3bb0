"""Sets of keys as bitmaps of a bounded size, which every task can have whatever the number of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one map, a row of the bitmap.
MAP_BITS = 1 << 15


def maps_for(keys: int, bits_a_key: int, most: int) -> int:
    """How many maps serve so many keys, at most ``most``: a set bit then says less, and nothing else changes."""
    return min(most, max(1, -(-keys * bits_a_key // MAP_BITS)))


def place(maps: int, *keys: Column | str) -> Column:
    """The bit of a key, by hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(maps * MAP_BITS))


def bitmap(places: DataFrame) -> DataFrame:
    """places (at long) -> (__map, __bits), to be broadcast."""
    at = places.groupBy(F.floor(F.col("at") / MAP_BITS).cast("int").alias("__map"))
    return at.agg(F.bitmap_construct_agg(F.pmod("at", F.lit(MAP_BITS))).alias("__bits"))


def marked(rows: DataFrame, at: Column, bits: DataFrame) -> DataFrame:
    """``rows`` with __hit: whether the bit at ``at`` is set. Nothing is shuffled."""
    rows = rows.withColumn("__at", at).withColumn("__map", F.floor(F.col("__at") / MAP_BITS).cast("int")).withColumn("__at", F.pmod("__at", F.lit(MAP_BITS)))
    byte = F.expr("conv(hex(substring(__bits, cast(__at div 8 + 1 as int), 1)), 16, 10)").cast("long")
    hit = F.getbit(byte, F.expr("cast(__at & 7 as int)")) == 1
    return rows.join(F.broadcast(bits), "__map", "left").withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__map", "__at", "__bits")

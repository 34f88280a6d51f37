"""A one-hash Bloom filter of fixed size: prunes rows before a shuffle, never decides.

Its size is a constant whatever the data, so it may be broadcast; as keys grow beyond it, it only prunes less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 32768  # bits in a page of Spark's bitmap functions


def slots_of(keys: DataFrame, slot: Column) -> DataFrame:
    """(page, bitmap) of slots: one row of 4 KB for each 32768 slots that has any."""
    return (
        keys.select(F.shiftright(slot, 15).alias("page"), slot.bitwiseAND(F.lit(PAGE - 1)).alias("bit"))
        .groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def pruned(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 23, outside: bool = False) -> DataFrame:
    """df's rows whose key may be among keys' column of the same name, or with `outside` all the others.

    Null keys are outside. The broadcast has at most bits / 8 bytes, 1 MB by default.
    """
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    found = slots_of(keys.where(F.col(key).isNotNull()), slot(F.col(key))).withColumnsRenamed({"page": "__page", "bitmap": "__bitmap"})
    with_page = df.withColumn("__slot", slot(F.col(key)))
    joined = with_page.join(F.broadcast(found), F.shiftright("__slot", 15) == F.col("__page"), "left")
    bit = F.col("__slot").bitwiseAND(F.lit(PAGE - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("__bitmap", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.get(F.array(*(F.lit(1 << k) for k in range(8))), bit.bitwiseAND(F.lit(7))).bitwiseAND(byte) != 0, F.lit(False)) & F.col(key).isNotNull()
    return joined.where(~inside if outside else inside).drop("__slot", "__page", "__bitmap")

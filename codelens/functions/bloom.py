"""Bloom filters as small tables of bitmaps, made and asked with SQL functions only.

A filter has blocks of one bitmap each. A key belongs to one block and sets a few bits
in it, so a probe is one join with the blocks. It never says no to a key it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768  # what Spark's bitmap functions hold in one bitmap
BITS_PER_KEY = 10
BITS_SET = 4
MAX_BYTES = 32 * 1024 * 1024


def blocks_for(n_keys: int) -> int | None:
    """How many blocks so many keys take, or None if they are too large to broadcast."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))
    return blocks if blocks * BLOCK_BITS // 8 <= MAX_BYTES else None


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(at)), F.lit(BLOCK_BITS)) for at in range(BITS_SET)]


def build(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    """The filter of the keys: one row for each block that holds any."""
    set_bits = df.select(_block(key, blocks).alias("_block"), F.explode(F.array(*_bits(key))).alias("_bit"))
    return set_bits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def may_hold(df: DataFrame, key: Column, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key the filter may hold; it is broadcast, so no row moves."""

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("_bitmap", F.expr("1") + F.floor(bit / 8).cast("int"), F.lit(1))), 16, 10)
        return F.getbit(byte.cast("int"), (bit % 8).cast("int")) == 1

    probed = df.withColumn("_block", _block(key, blocks)).join(F.broadcast(bloom), "_block")
    for bit in _bits(key):
        probed = probed.filter(is_set(bit))
    return probed.drop("_block", "_bitmap")

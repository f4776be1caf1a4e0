"""Semi-joins by one bit a key, so that the rows of the large side, with their texts, are not shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of 32,768 bits that are broadcast at most: 64 MB, or 500 million keys that lie close together.
BLOCKS = 1 << 14


def bit_blocks(keys: DataFrame, key: str) -> DataFrame:
    """(_block, _bits): a bit for each of the keys, which are longs, 32,768 neighbouring ones a row."""
    placed = keys.select(F.bitmap_bucket_number(key).alias("_block"), F.bitmap_bit_position(key).alias("_bit"))
    # Keys go to their block before they become bits: tasks with few keys of a block each would else send 4 kB for it.
    return placed.repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def having_bit(rows: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows whose key has a bit. Up to BLOCKS blocks are broadcast; with more, the join is left to Spark."""
    placed = rows.withColumns({"_block": F.bitmap_bucket_number(key), "_bit": F.bitmap_bit_position(key)})
    bit = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1")
    return placed.join(F.broadcast(blocks) if n_blocks <= BLOCKS else blocks, "_block").where(bit == 1).select(*rows.columns)

"""Rows whose id is among others, told before anything is shuffled.

A bitmap has one bit for each cell that an id's hash can fall in, and is broadcast in blocks of
4 kB, those that have a bit set. A row whose cell is not set is not among the ids for certain;
the others are to be joined. Sixteen cells an id let some six in a hundred others through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtide.llm.common import free_name

CELLS_PER_ID = 16
MIN_CELLS = 1 << 17
# 16 MB, the bound of what is broadcast. Beyond 8 million ids the bitmap gets fuller and lets more rows through.
MAX_CELLS = 1 << 27
_BLOCK_BITS = 15  # of the bitmaps that Spark's functions make


def _place(id_: Column, cells: int) -> tuple[Column, Column]:
    """The block of an id's cell, and the bit in it."""
    cell = F.xxhash64(id_.cast("bigint")).bitwiseAND(F.lit(cells - 1))
    return F.shiftright(cell, _BLOCK_BITS), cell.bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).cast("int")


def mark_among(rows: DataFrame, id_col: str, ids: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a column ``mark``: false where the id is null or not among those of the one column of ``ids``
    for certain. ``ids``, which may repeat, are read twice, so give them written."""
    wanted = max(MIN_CELLS, min(MAX_CELLS, ids.count() * CELLS_PER_ID))
    cells = 1 << (wanted - 1).bit_length()
    block_name, map_name = free_name(rows, "_block"), free_name(rows, "_map")
    block, bit = _place(F.col(ids.columns[0]), cells)
    maps = ids.dropna().select(block.alias(block_name), bit.alias("_bit")).groupBy(block_name)
    maps = maps.agg(F.bitmap_construct_agg("_bit").alias(map_name))
    block, bit = _place(F.col(id_col), cells)
    found = rows.join(F.broadcast(maps), (block == F.col(block_name)) & F.col(id_col).isNotNull(), "left")
    byte = F.conv(F.hex(F.substring(F.col(map_name), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1
    return found.withColumn(mark, F.coalesce(is_set, F.lit(False))).drop(block_name, map_name)

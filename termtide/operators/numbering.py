"""Row numbers in a sorted order, and a keyed permutation of them.

A seeded shuffle by row numbers needs no random keys to be sorted: rows are numbered once in the order of
their key, and a Feistel network turns the numbers 0 to n - 1 into one another. Each number says
where its row belongs, so that every output file gets exactly its share of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termtide.session import stage

ROUNDS = 4
# A walk leaves the numbers beyond n with a chance of a half or more at each step.
_STEPS = 96


def row_numbers(rows: DataFrame, order: Sequence[Column], name: str) -> tuple[DataFrame, int]:
    """``rows`` with their number from 0 in the given order, and how many they are.

    Rows are dealt out by ranges of the order and sorted in them; the counts of the ranges, one small
    row each, give every range its first number. The order has to tell all rows apart if the
    numbers are to be the same on every run.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(
        dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "sorted-rows"
    )
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_held"), F.min("_at").alias("_first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")
    starts = stage(sizes.select("_range", "_held", shift.alias("_shift")), "range-starts")
    total = starts.agg(F.sum("_held")).head()[0] or 0
    numbered = placed.join(starts.drop("_held"), "_range")
    return numbered.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name)), total


def _round_value(half: Column, turn: Column, seed: int, bits: int) -> Column:
    """Some bits of a digest of a half of a number, the round and the seed."""
    text = F.concat(F.lit(f"{seed}:"), turn.cast("string"), F.lit(":"), half.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % (1 << bits)


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """Where a number from 0 to ``n - 1`` goes under the permutation of a seed.

    The halves of its bits take turns in changing one another, which can be undone and so is a permutation of all
    numbers of so many bits (less than 2n); one that falls beyond n goes on until it is within.
    """
    bits = max(2, (n - 1).bit_length())
    if bits > 62:
        raise ValueError("too many rows for numbers of 62 bits")
    low_bits = bits // 2
    high_bits = bits - low_bits
    if low_bits > 32 or high_bits > 32:
        raise ValueError("halves have 32 bits at most")
    low_size = 1 << low_bits

    def once(x: Column) -> Column:
        def turn(h: Column, r: Column) -> Column:
            high = h["high"].bitwiseXOR(_round_value(h["low"], r, seed, high_bits))
            low = h["low"].bitwiseXOR(_round_value(h["high"], r, seed, low_bits))
            even = r % 2 == 0
            return F.struct(F.when(even, high).otherwise(h["high"]).alias("high"), F.when(even, h["low"]).otherwise(low).alias("low"))

        halves = F.struct(F.floor(x / low_size).cast("bigint").alias("high"), (x % low_size).cast("bigint").alias("low"))
        mixed = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda h: h["high"] * low_size + h["low"])
        return mixed

    first = F.aggregate(F.array(number.cast("bigint")), F.lit(0).cast("bigint"), lambda _, x: once(x))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(_STEPS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x))
    )
    checked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a number left the permutation")).cast("bigint"))
    return checked if n & (n - 1) or n < 4 else first


def seeded_shuffle(rows: DataFrame, order: Sequence[Column], seed: int = 0, name: str = "place") -> tuple[DataFrame, int]:
    """``rows`` with their ``place`` in a seeded shuffle, and how many they are; see ``write_shuffled`` for files."""
    numbered, total = row_numbers(rows, order, "_number")
    if not total:
        return numbered.withColumnRenamed("_number", name), 0
    return numbered.withColumn(name, permuted(F.col("_number"), total, seed)).drop("_number"), total


def write_shuffled(rows: DataFrame, order: Sequence[Column], path: str, rows_per_file: int, seed: int = 0) -> int:
    """Writes a seeded shuffle as files of ``rows_per_file`` rows (the last may have fewer), in order by name,
    each sorted by ``place``; returns the number of files. Rows go straight to the file their place names."""
    if rows_per_file < 1:
        raise ValueError("a file holds at least one row")
    placed, total = seeded_shuffle(rows, order, seed, "place")
    files = max(1, -(-total // rows_per_file))
    file = F.floor(F.col("place") / rows_per_file).cast("int")
    dealt = placed.repartitionById(files, file).sortWithinPartitions("place")
    dealt.write.option("maxRecordsPerFile", 0).parquet(path)
    return files

"""Line order of text files.

Files are read in parallel, so the place of a row is derived from the file, the
block within it and the row's number in its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termtide.session import stage

_BLOCK = ["_file", "_block"]


def with_place(df: DataFrame) -> DataFrame:
    """``_file, _block, _row``: sorts rows read from files in their file order.

    Has to come before any filter, so that every row of the file is numbered.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def place() -> Column:
    return F.struct(*_BLOCK, "_row")


def numbered(df: DataFrame, name: str = "line") -> DataFrame:
    """Rows with their number in file order, from 0, as column ``name``.

    The placed rows are written once, and both the counts and the rows are taken
    from that table: read twice, the files might be packed into tasks in another
    way. The running total over the blocks (one small row each) gives every block
    its first number.
    """
    placed = stage(with_place(df), "file-lines")
    sizes = placed.groupBy(*_BLOCK).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_first")
    )
    before = Window.orderBy(*_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *_BLOCK, (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return placed.join(stage(starts, "file-blocks"), _BLOCK).select(
        *df.columns, (F.col("_row") + F.col("_shift")).alias(name)
    )


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` per line, without the byte-order mark a file may begin with."""
    lines = spark.read.text(path)
    return lines.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))

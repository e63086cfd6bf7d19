"""Places of rows in a sorted order, found without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termtide.session import stage


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], place: str, total: str) -> DataFrame:
    """``rows`` with their ``place`` (from 0) within their group and the group's number of rows.

    ``group`` names columns without nulls. Rows are dealt out by ranges of group and order, so a
    group of any size spreads over many tasks; the counts of each range, one row for each of its
    groups, give every range its first place. Only rows equal in all of ``order`` stay together.
    Columns called ``_range``, ``_at``, ``_first``, ``_shift`` or ``_held`` are not to be there.
    """
    sorts = [*[F.asc(g) for g in group], *order]
    dealt = rows.repartitionByRange(*sorts).sortWithinPartitions(*sorts)
    placed = stage(
        dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "sorted-rows"
    )
    sizes = placed.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_held"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_range",
        *group,
        (F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_held").over(whole).alias(total),
    )
    joined = placed.join(stage(starts, "range-starts"), ["_range", *group])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(place), total)


def own_ids(rows: DataFrame, id_col: str, text: str, nulls_last: bool) -> tuple[DataFrame, str] | None:
    """``rows`` with a number of its own for each, in the order of the ids (then the texts), and the number's column.

    None where each row has an id of its own; it then serves as it is.
    """
    shared = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(id_col).isNull())
    if not shared.head(1):
        return None
    order = F.asc_nulls_last(id_col) if nulls_last else F.asc_nulls_first(id_col)
    return numbered(rows, [], [order, F.asc(text)], "_number", "_rows").drop("_rows"), "_number"

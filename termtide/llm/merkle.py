"""Merkle trees over a dataset, a level of each aligned block kept as one string of hex digests.

Rows are leaves. Within each group leaves are in order; while a level has more than one node, every
``FAN`` consecutive ones (the last run: fewer, even one) become the digest of their concatenated hex
texts. What remains is the group's subroot; the subroots, in the order of their groups, likewise give the root.

A block holds ``FAN ** HEIGHT`` consecutive nodes, so the runs of the levels in it lie in it too. Its level
is a string of 64 characters a node: a parent is the digest of a substring of ``FAN`` nodes, and the
siblings of a node are the substrings on its two sides in its run. The top nodes of the blocks are the
leaves of a next tier of blocks, until a group has one. No task ever holds more of a group than a block.

Defined results: nulls are fields like any other (see ``leaf``), rows without order value come first, rows
equal in it by their digest; equal rows are leaves of their own; an empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtide.llm.ordering import numbered
from termtide.operators.joins import lookup_join
from termtide.session import stage

FAN = 8
HEIGHT = 3
HEX = 64
BLOCK = FAN**HEIGHT
ADDED = ("steps", "subroot", "root")
_STEPS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields, each written so that no two rows share a text."""
    return digest(F.concat(*[field(v) for v in values]))


def folded(node: Column, steps: Column) -> Column:
    """The root that a node and the siblings on its way up give."""
    return F.aggregate(steps, node, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


def siblings(steps: Column) -> Column:
    """All siblings on the way up as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def _parents(level: str) -> Column:
    run = FAN * HEX
    return F.expr(
        f"array_join(transform(sequence(0, (length({level}) - 1) div {run}),"
        f" i -> sha2(cast(substring({level}, i * {run} + 1, {run}) as binary), 256)), '')"
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    """``_group, _block, _total, members, levels, top`` from ``_group, _place, _total, _node, _row``.

    ``levels`` are the levels that have parents in this block. A group of one block ends with
    one node; blocks of a larger group all go up ``HEIGHT`` levels.
    """
    rows = nodes.groupBy("_group", F.floor(F.col("_place") / BLOCK).alias("_block")).agg(
        F.max("_total").alias("_total"),
        F.array_sort(F.collect_list(F.struct("_place", "_node", "_row"))).alias("members"),  # at most a block
    )
    out = rows.withColumn("_l0", F.array_join(F.transform("members", lambda m: m["_node"]), ""))
    whole = F.col("_total") > BLOCK
    for i in range(HEIGHT):
        goes_up = whole | (F.length(f"_l{i}") > HEX)
        out = out.withColumn(f"_l{i + 1}", F.when(goes_up, _parents(f"_l{i}")))
    used = [F.when(F.col(f"_l{i + 1}").isNotNull(), F.col(f"_l{i}")) for i in range(HEIGHT)]
    top = F.coalesce(*[F.col(f"_l{i}") for i in range(HEIGHT, -1, -1)])
    return out.select("_group", "_block", "_total", "members", F.array_compact(F.array(*used)).alias("levels"), top.alias("top"))


def _expanded(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """One row per member, ``_group, _place, _row, steps, subroot``: its way up in the block, then the block's own."""
    run = FAN * HEX
    index = f"shiftright(cast(m._place % {BLOCK} as int), {FAN.bit_length() - 1} * l)"
    start, within = f"({index} div {FAN}) * {run} + 1", f"({index} % {FAN})"
    step = (
        f"named_struct('left', substring(s, {start}, {within} * {HEX}),"
        f" 'right', substring(s, {start} + ({within} + 1) * {HEX}, ({FAN} - 1 - {within}) * {HEX}))"
    )
    found = F.expr(
        "transform(members, m -> named_struct('_place', m._place, '_row', m._row,"
        f" 'steps', concat(transform(levels, (s, l) -> {step}), above)))"
    )
    joined = lookup_join(blocks, above, ["_group", "_block"], "inner")
    return joined.select("_group", "subroot", F.explode(found).alias("m")).select(
        "_group", "m._place", "m._row", "m.steps", "subroot"
    )


def _tops(blocks: DataFrame) -> DataFrame:
    """``_group, _block, above, subroot`` of groups that end in this tier."""
    return blocks.filter(F.col("_total") <= BLOCK).select(
        "_group", "_block", F.array().cast(_STEPS).alias("above"), F.col("top").alias("subroot")
    )


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the leaves up; each has one row where the one below has a block's worth."""
    tiers = [stage(_blocks(nodes), "merkle-tier")]
    while (higher := tiers[-1].filter(F.col("_total") > BLOCK)).head(1):
        nodes = higher.select(
            "_group",
            F.col("_block").alias("_place"),
            F.ceil(F.col("_total") / BLOCK).alias("_total"),
            F.col("top").alias("_node"),
            F.lit(0).alias("_row"),
        )
        tiers.append(stage(_blocks(nodes), "merkle-tier"))
    return tiers


def _above(tiers: list[DataFrame]) -> DataFrame:
    """The way from each block of the lowest tier to its group's subroot."""
    above = _tops(tiers[-1])
    for below, tier in zip(tiers[-2::-1], tiers[:0:-1], strict=True):
        higher = _expanded(tier, above).select("_group", F.col("_place").alias("_block"), F.col("steps").alias("above"), "subroot")
        above = _tops(below).unionByName(higher)
    return stage(above, "merkle-ways")


@dataclass(frozen=True)
class Manifest:
    """The tree of a dataset: ``tiers`` of blocks over its rows, ``groups`` with their way to the root."""

    columns: list[str]
    tiers: list[DataFrame]
    above: DataFrame
    groups: DataFrame

    def levels(self) -> DataFrame:
        """``tier, group_key, block, levels, top``: what a reader keeps to tell which block has changed."""
        parts = [
            t.select(F.lit(i).alias("tier"), F.col("_group").alias("group_key"), F.col("_block").alias("block"), "levels", "top")
            for i, t in enumerate(self.tiers)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def proofs(self) -> DataFrame:
        """The rows with ``steps`` (siblings left and right, from the leaf to the root), ``subroot, root``."""
        ways = lookup_join(self.above, self.groups, ["_group"], "inner").select(
            "_group", "_block", F.concat("above", "group_steps").alias("above"), F.struct("subroot", "root").alias("subroot")
        )
        rows = _expanded(self.tiers[0], ways)
        kept = [F.col("_row")[c].alias(c) for c in self.columns if c not in ADDED]
        return rows.select(*kept, "steps", F.col("subroot.subroot").alias("subroot"), F.col("subroot.root").alias("root"))


def manifest(rows: DataFrame, group: str, order: str, node: str = "leaf") -> Manifest:
    """The tree over ``rows`` whose digests are in column ``node``, per ``group`` in ascending ``order``.

    All columns are carried along, but for those called like the ones ``proofs`` adds. Texts should be
    left out: the leaf stands for them.
    """
    named = stage(
        rows.select(field(F.col(group)).alias("_group"), F.col(group).alias("_name"), F.col(order).alias("_by"),
                    F.col(node).alias("_node"), F.struct(*rows.columns).alias("_row")),
        "merkle-leaves",
    ).withColumn("_tie", F.monotonically_increasing_id())
    by_place = numbered(named, ["_group"], [F.asc_nulls_first("_by"), F.asc("_node"), F.asc("_tie")], "_place", "_total")
    tiers = _tiers(by_place.select("_group", "_place", "_total", "_node", "_row"))
    above = _above(tiers)

    names = named.select("_group", "_name").distinct()
    roots = names.join(above.filter("_block = 0").select("_group", "subroot"), "_group")
    top = roots.select(F.lit("").alias("_all"), "_name", F.col("subroot").alias("_node"), F.struct("_group").alias("_row"))
    places = numbered(top, ["_all"], [F.asc_nulls_first("_name")], "_place", "_total")
    upper = _tiers(places.select(F.col("_all").alias("_group"), "_place", "_total", "_node", "_row"))
    ways = _expanded(upper[0], _above(upper))
    groups = ways.select(F.col("_row._group").alias("_group"), F.col("steps").alias("group_steps"), F.col("subroot").alias("root"))
    return Manifest(list(rows.columns), tiers, above, stage(groups, "merkle-groups"))

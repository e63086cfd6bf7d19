"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces and the gaps of open sequences are range-sorted together by size, largest
first. One sweep over that order gives each piece its successor: the smallest gap
not smaller than it that no larger piece has taken. Every range is swept by one
task; what a range cannot match itself is settled between ranges by rank: the
r-th piece left over takes the r-th smallest gap left in the ranges before. The
gaps are updated and the round repeats. Pieces are taken in classes of falling
size, as best-fit decreasing does; those that fit nowhere open new sequences, the
largest first and only as many as their tokens need, and what is left after a second
round joins the next class.

A round moves rows of a few numbers; texts and ids never move. Very short pieces
are first tied into bundles, so that the number of rounds depends on the length
of a sequence and not on the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termtide.llm import tokens
from termtide.llm.common import forget, text_batches
from termtide.session import scratch_path, stage

SEQUENCE_TOKENS = 2048
BUNDLED = 64  # pieces up to this length are tied into bundles of up to twice as much
ROWS_PER_RANGE = 50_000
_SHARES = 1_000_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the documents' ids with the end id, cut only
    where they are longer than a sequence. A null text counts as empty and has one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text"):
            doc, piece, start, length, crcs = [], [], [], [], []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encoded(batch, "text", vocabulary), strict=True):
                n = len(ids) // 4
                for k, low in enumerate(range(0, n, capacity)):
                    part = ids[4 * low : 4 * (low + capacity)]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(low)
                    length.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crcs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _PIECES)


def _ranges(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_RANGE))


_SWEPT = "part int, kind int, rank bigint, item bigint, length bigint, bin bigint"
_PAIR, _ITEM, _GAP = 0, 1, 2


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, largest first, gaps before pieces of the same size: pairs, pieces left, gaps left.

    Holds one range: ``ROWS_PER_RANGE`` rows on average.
    """
    forget()
    part = TaskContext.get().partitionId()
    open_gaps: list[int] = []
    rows: list[tuple] = []
    left = 0
    for batch in batches:
        for size, is_item, number in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not is_item:
                open_gaps.append(number)
            elif open_gaps:
                rows.append((part, _PAIR, 0, number, size, open_gaps.pop()))
            else:
                rows.append((part, _ITEM, left, number, size, 0))
                left += 1
    # rank 0: the smallest gap left, which the first piece of a later range takes
    rows += [(part, _GAP, r, 0, 0, number) for r, number in enumerate(reversed(open_gaps))]
    if rows:
        table = np.array(rows, np.int64)
        types = [pa.int32(), pa.int32()] + [pa.int64()] * 4
        arrays = [pa.array(table[:, i]).cast(t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "kind", "rank", "item", "length", "bin"])


def _settled(counts: list) -> list[tuple[int, int, int, int, int]]:
    """Which pieces left in a range take which gaps left in ranges before: ``part, first rank, end rank,
    part of the gaps, shift`` (rank of the gap = rank of the piece + shift). A row or two for each range."""
    by_part: dict[int, dict[int, int]] = {}
    for row in counts:
        by_part.setdefault(row.part, {})[row.kind] = row["count"]
    stack: list[list[int]] = []  # part, next rank, gaps left
    rows = []
    for part in sorted(by_part):
        taken, need = 0, by_part[part].get(_ITEM, 0)
        while need and stack:
            top = stack[-1]
            n = min(need, top[2])
            rows.append((part, taken, taken + n, top[0], top[1] - taken))
            taken, need = taken + n, need - n
            top[1], top[2] = top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if by_part[part].get(_GAP):
            stack.append([part, 0, by_part[part][_GAP]])
    return rows


class _Packer:
    def __init__(self, spark: SparkSession, capacity: int):
        self.spark, self.capacity = spark, capacity
        self.path = scratch_path(spark, "packing")
        self.rounds = 0

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{self.rounds}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _place(self, pairs: DataFrame) -> DataFrame:
        self.rounds += 1
        path = f"{self.path}/placed/round={self.rounds}"
        pairs.select("item", "bin", "offset", "length").write.parquet(path)
        return self.spark.read.parquet(path)

    def opened(self, seeds: DataFrame) -> DataFrame:
        """Opens a sequence, numbered as the piece, for each of the seeds; returns their gaps."""
        placed = self._place(
            seeds.select("item", F.col("item").alias("bin"), F.lit(0).cast("bigint").alias("offset"), "length")
        )
        return placed.select("bin", (F.lit(self.capacity) - F.col("length")).alias("gap"))

    def matched(self, items: DataFrame, gaps: DataFrame, longest: int, rows: int) -> tuple[DataFrame | None, int]:
        """One round: ``item, bin, offset, length`` as placed, and how many; ``longest`` bounds the pieces.

        A gap of several times that size has as many places in this round, all wide enough.
        """
        places = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("gap") / longest))
        slots = gaps.select(
            F.floor(F.col("gap") / places).alias("size"),
            F.lit(0).alias("is_item"),
            F.col("bin").alias("number"),
            F.explode(F.sequence(F.lit(1).cast("bigint"), places)).alias("slot"),
        )
        pieces = items.select(
            F.col("length").alias("size"), F.lit(1).alias("is_item"), F.col("item").alias("number"), F.lit(0).cast("bigint").alias("slot")
        )
        order = [F.desc("size"), F.asc("is_item"), F.asc("number"), F.asc("slot")]
        ranged = pieces.unionByName(slots).repartitionByRange(_ranges(rows), *order).sortWithinPartitions(*order)
        self.rounds += 1
        swept = self._table(ranged.mapInArrow(_sweep, _SWEPT), "swept")
        counts = swept.groupBy("part", "kind").count().collect()  # three rows a range
        segments = _settled(counts)
        n = sum(r["count"] for r in counts if r.kind == _PAIR) + sum(s[2] - s[1] for s in segments)
        if not n:
            return None, 0
        pairs = swept.filter(F.col("kind") == _PAIR).select("item", "bin", "length")
        if segments:
            # at most two rows for each range, and for each of these at most two more
            known = self.spark.createDataFrame(segments, "part int, low bigint, high bigint, gap_part int, shift bigint")
            takers = swept.filter(F.col("kind") == _ITEM).join(F.broadcast(known), "part")
            takers = takers.filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
                "item", "length", "gap_part", (F.col("rank") + F.col("shift")).alias("gap_rank")
            )
            givers = swept.filter(F.col("kind") == _GAP).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "bin")
            carried = takers.join(givers, ["gap_part", "gap_rank"]).select("item", "bin", "length")
            pairs = pairs.unionByName(carried)
        # a sequence has at most as many rows here as places
        before = Window.partitionBy("bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
        at = F.lit(self.capacity) - F.col("gap") + F.coalesce(F.sum("length").over(before), F.lit(0))
        return self._place(pairs.join(gaps, "bin").withColumn("offset", at)), n

    def pack(self, items: DataFrame) -> DataFrame:
        """``item, bin, offset`` for ``item, length`` (1 to the capacity)."""
        half = self.capacity // 2
        gaps = self._table(self.opened(items.filter(F.col("length") > half)), "gaps")
        high, left = half, items.limit(0)
        while high:
            low = high // 2 if high // 2 >= 2 * BUNDLED else 0
            own = items.filter((F.col("length") > low) & (F.col("length") <= high))
            left, gaps, _ = self._step(own.unionByName(left), gaps)
            high = low
        rest = 1
        while rest:
            left, gaps, rest = self._step(left, gaps)
        return self.spark.read.schema("item bigint, bin bigint, offset bigint, length bigint, round int").parquet(
            f"{self.path}/placed"
        )

    def _step(self, items: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """A round in the gaps there are, new sequences for what fits nowhere, and a round with their gaps.

        Returns the pieces left, the gaps, and how many pieces are left.
        """
        counts = self._lengths(items)
        items, gaps, counts = self._round(items, gaps, counts)
        if counts:
            seeds = self._seeds(items, counts)
            opened = self.opened(seeds)
            gaps = self._table(gaps.unionByName(opened.filter("gap > 0")), "gaps-opened")
            items = self._table(items.join(seeds.select("item"), "item", "left_anti"), "items-left")
            items, gaps, counts = self._round(items, gaps, self._lengths(items))
        return items, gaps, sum(counts.values())

    @staticmethod
    def _lengths(items: DataFrame) -> dict[int, int]:
        """How many pieces there are of each length: one row for each."""
        return {r.length: r["count"] for r in items.groupBy("length").count().collect()}

    def _round(self, items: DataFrame, gaps: DataFrame, counts: dict[int, int]) -> tuple[DataFrame, DataFrame, dict[int, int]]:
        if not counts:
            return items, gaps, counts
        total = sum(counts.values())
        fitting = gaps.filter(F.col("gap") >= min(counts))
        placed, n = self.matched(items, fitting, max(counts), 2 * total)
        if not n:
            return items, gaps, counts
        taken = placed.groupBy("bin").agg(F.sum("length").alias("_taken"))
        rest = gaps.join(taken, "bin", "left").select("bin", (F.col("gap") - F.coalesce("_taken", F.lit(0))).alias("gap"))
        gaps = self._table(rest.filter("gap > 0"), "gaps")
        if n == total:
            return items.limit(0), gaps, {}
        items = self._table(items.join(placed.select("item"), "item", "left_anti"), "items")
        return items, gaps, self._lengths(items)

    def _seeds(self, items: DataFrame, counts: dict[int, int]) -> DataFrame:
        """The largest pieces, as many as sequences their tokens fill; a share of those of the last length."""
        wanted = -(-sum(n * size for size, n in counts.items()) // self.capacity)
        for size in sorted(counts, reverse=True):
            if counts[size] >= wanted:
                share = -(-wanted * _SHARES // counts[size])
                some = F.pmod(F.xxhash64("item"), F.lit(_SHARES)) < share
                chosen = (F.col("length") > size) | ((F.col("length") == size) & some)
                first = items.filter(F.col("length") == size).agg(F.min("item")).scalar()
                return items.filter(chosen | (F.col("item") == first))
            wanted -= counts[size]
        return items


_BUNDLES = "item bigint, length bigint, bundle bigint, inner bigint"


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties short pieces, in their order, into bundles of up to twice ``BUNDLED``, numbered as their first piece."""
    bundle, size = None, 0
    for batch in batches:
        bundles, inner = [], []
        for item, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bundle is None or size + length > 2 * BUNDLED:
                bundle, size = item, 0
            bundles.append(bundle)
            inner.append(size)
            size += length
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(bundles, pa.int64()), pa.array(inner, pa.int64())],
            ["item", "length", "bundle", "inner"],
        )


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: which sequence holds a piece and where.

    ``pieces`` has a ``length`` from 1 to ``capacity``; other lengths and null end
    the job. Places in a sequence follow one another without a gap from 0. Columns of the
    new names are replaced; no pieces give no rows.
    """
    spark = pieces.sparkSession
    bad = F.raise_error(F.lit("a piece's length is not from 1 to the length of a sequence"))
    checked = F.when(F.col("length").between(1, capacity), F.col("length").cast("bigint")).otherwise(bad.cast("bigint"))
    plain = pieces.drop("sequence_id", "offset", "_item")
    with text_batches(pieces.sparkSession):  # the pieces may be cut from texts here
        numbered = stage(plain.withColumn("_item", F.monotonically_increasing_id()).withColumn("length", checked), "pieces")
    items = numbered.select(F.col("_item").alias("item"), "length")
    short = items.filter(F.col("length") <= BUNDLED)
    n = _ranges(short.count())
    # dealt out by hash, so that lengths are mixed within a bundle's neighbourhood
    tied = short.repartition(n, F.xxhash64("item")).sortWithinPartitions(F.desc("length"), "item").mapInArrow(_tie, _BUNDLES)
    tied = stage(tied, "bundles")
    bundled = tied.groupBy("bundle").agg(F.sum("length").alias("length"))  # at most 2 * BUNDLED rows each
    whole = items.filter((F.col("length") > BUNDLED) & (F.col("length") < capacity))
    packer = _Packer(spark, capacity)
    placed = packer.pack(stage(whole.unionByName(bundled.select(F.col("bundle").alias("item"), "length")), "items"))
    placed = placed.select("item", "bin", "offset")
    single = placed.join(whole, "item", "left_semi")
    inner = tied.join(placed.select(F.col("item").alias("bundle"), "bin", "offset"), "bundle").select(
        "item", "bin", (F.col("offset") + F.col("inner")).alias("offset")
    )
    full = items.filter(F.col("length") == capacity).select("item", F.col("item").alias("bin"), F.lit(0).cast("bigint").alias("offset"))
    places = single.unionByName(inner).unionByName(full)
    places = places.select(F.col("item").alias("_item"), F.col("bin").alias("sequence_id"), "offset")
    return numbered.join(places, "_item").drop("_item")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all documents."""
    return pack(cut_documents(docs, vocabulary, capacity), capacity)

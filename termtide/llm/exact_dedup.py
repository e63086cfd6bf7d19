"""Exact deduplication with a two-pass Bloom filter.

The first pass puts a 64-bit hash of every text into a counting filter of two
bits a cell: set once, set more than once. Each task fills its own filter and
sends on the blocks it touched; the blocks of all tasks are merged. The second
pass looks every hash up: a hash that has a cell set only once cannot repeat, so
its row passes straight through. Only the others are shuffled, and compared by
the SHA-256 of the whole text, so that a false alarm of the filter costs some
work and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.llm.common import filled, free_name, released, without_spaces
from termtide.operators.joins import lookup_join
from termtide.session import stage

PROBES = 4
CELLS_PER_ROW = 16
# 2^27 cells are 16 MB for each of the two bits: the bound of what is broadcast.
# Beyond 8 million rows the filter gets fuller and lets more rows through to the
# exact comparison; the result stays the same.
MAX_CELLS = 1 << 27
MIN_CELLS = 1 << 17
_BLOCK = 1 << 15  # cells


def cells_for(rows: int) -> int:
    """A power of two with ``CELLS_PER_ROW`` cells a row, within the bounds."""
    wanted = max(MIN_CELLS, min(MAX_CELLS, rows * CELLS_PER_ROW))
    return 1 << (wanted - 1).bit_length()


def cell_numbers(hashes: np.ndarray, cells: int, probes: int = PROBES) -> Iterator[np.ndarray]:
    """The cells of each hash, one array for each probe; every probe has its own part of the filter."""
    part = cells // probes
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(probes):
        x = h + step * np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        yield (x & np.uint64(part - 1)).astype(np.int64) + i * part


def _set(bits: np.ndarray, cells: np.ndarray) -> None:
    np.bitwise_or.at(bits, cells >> 3, np.left_shift(1, cells & 7).astype(np.uint8))


def _get(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0


_BLOCKS = "block bigint, once binary, twice binary"


def _fill(cells: int, probes: int, of: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        for batch in batches if of is None else of(batches):
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            for numbers in cell_numbers(hashes, cells, probes):
                own, n = np.unique(numbers, return_counts=True)
                _set(twice, own[(n > 1) | _get(once, own)])
                _set(once, own)
        width = _BLOCK // 8
        for block in np.flatnonzero(once.reshape(-1, width).any(axis=1)):
            at = slice(block * width, (block + 1) * width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([once[at].tobytes()]), pa.array([twice[at].tobytes()])],
                ["block", "once", "twice"],
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the blocks of a number, which follow each other; holds one at a time."""
    number, once, twice = None, None, None

    def done() -> Iterator[pa.RecordBatch]:
        if number is not None and twice.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([twice.tobytes()])], ["block", "twice"]
            )

    for batch in batches:
        for n, a, b in zip(*(batch.column(i) for i in range(3)), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b))
            if n.as_py() != number:
                yield from done()
                number, once, twice = n.as_py(), a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    yield from done()


def repeat_filter(hashes: DataFrame, cells: int, probes: int = PROBES, of: Callable | None = None) -> np.ndarray:
    """The bits of the cells set more than once by the one column of ``hashes``, or by that of the batches which
    ``of`` makes of its batches: in the same worker, as two steps one after the other would take two for each task."""
    merged = (
        hashes.mapInArrow(released(_fill(cells, probes, of)), _BLOCKS)
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_merge, "block bigint, twice binary")
    )
    bits = np.zeros(cells // 8, np.uint8)
    width = _BLOCK // 8
    for row in merged.collect():  # at most cells / 8 bytes, see MAX_CELLS
        bits[row.block * width : (row.block + 1) * width] = np.frombuffer(row.twice, np.uint8)
    return bits


def mark_repeats(docs: DataFrame, text: str, maybe: str, digest: str, length: str) -> DataFrame:
    """``docs`` with the SHA-256 of the text without white space, its length in code points, and
    whether another row may have the same text."""
    spark = docs.sparkSession
    key = without_spaces(filled(text))
    cells = cells_for(docs.count())
    bits = spark.sparkContext.broadcast(repeat_filter(docs.select(F.xxhash64(key)), cells))

    @F.pandas_udf("boolean")
    def may_repeat(hashes: pd.Series) -> pd.Series:
        found = np.ones(len(hashes), bool)
        for numbers in cell_numbers(hashes.to_numpy(), cells):
            found &= _get(bits.value, numbers)
        return pd.Series(found)

    return docs.withColumns(
        {digest: F.sha2(key.cast("binary"), 256), length: F.length(filled(text)), maybe: may_repeat(F.xxhash64(key))}
    )


def _winners(repeated: DataFrame, id_col: str, digest: str, length: str) -> DataFrame:
    """``digest, keep_id, group_size``: the longest text of each group, then the smallest id."""
    best = F.min(F.struct((-F.col(length)).alias("_short"), F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id")))
    return repeated.groupBy(digest).agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size")).select(
        digest, F.col("_best._id").alias("keep_id"), "group_size"
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal that are identical without white space; of a group the row
    with the longest original text (in code points), then the smallest id stays.
    A null text is an empty one, and all empty ones are equal. Rows that share an
    id share its fate; a row without id stays only if its group has no other. An
    empty table gives no rows; further columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    marked = mark_repeats(narrow, "text", "maybe", "text_sha256", "length").drop("text")
    marked = stage(marked, "exact-dedup")
    single = marked.filter("not maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    repeated = marked.filter("maybe")
    groups = _winners(repeated, "doc_id", "text_sha256", "length")
    found = lookup_join(repeated, groups, ["text_sha256"], "inner").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return single.unionByName(found)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with the columns of ``docs``; rules as in ``exact_groups``.

    Of several rows that share the id and the text that win, one stays: the longest.
    Texts that do not repeat are not shuffled. Of the others, only the row whose
    id won is fetched, by the id and the text's digest and length.
    """
    names = [free_name(docs, n) for n in ("maybe_repeats", "text_digest", "text_length")]
    maybe, digest, length = names
    marked = mark_repeats(docs, text, maybe, digest, length)
    repeated = marked.filter(F.col(maybe))
    groups = _winners(repeated.select(id_col, digest, length), id_col, digest, length)
    winners = groups.select(F.col("keep_id").alias("_keep"), F.col(digest).alias("_digest"))
    match = F.col(id_col).eqNullSafe(F.col("_keep")) & (F.col(digest) == F.col("_digest"))
    kept = repeated.join(winners, match, "left_semi")
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(length), F.xxhash64(text)))
    one = kept.groupBy(digest).agg(best.alias("_row")).select("_row.*")
    return marked.filter(~F.col(maybe)).drop(*names).unionByName(one)

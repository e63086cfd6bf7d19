"""Prefix patterns matched by one sweep over sorted words.

A prefix is an interval in the order of words: all words that begin with it follow one another. Words and
patterns are cut at the same bounds, each word going to one range and a prefix to every range its
interval meets. In each range words and patterns are sorted and swept once, with a stack of the prefixes that
are open: a word is matched by the innermost of them. The bounds are quantiles of the distinct words, so a
first letter that most words share is cut into many ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.session import ship_package, stage

# Words sampled for each range; the driver holds this many times the number of ranges.
SAMPLED = 60
_PREFIX, _WHOLE, _WORD = 0, 1, 2
# No byte of UTF-8: a prefix with it sorts behind all words that begin with the prefix.
_BEHIND = b"\xff"


def range_bounds(words: DataFrame, ranges: int) -> list[bytes]:
    """Where to cut sorted distinct words into ranges of about the same size, as UTF-8."""
    total = words.count()
    share = min(1.0, SAMPLED * ranges / max(total, 1))
    # a hash picks the sample, so that a task that runs again picks the same
    picked = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = sorted(w.encode() for w in picked.toArrow()["word"].to_pylist())
    if not sample:
        return []
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)})


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, labels`` of rows ``part, key, kind, labels`` sorted by the first three."""
    part, whole = None, None
    open_prefixes: list[tuple[str, list[str]]] = []
    for batch in batches:
        words, found = [], []
        # texts as such only here: order is that of their bytes
        for number, key, kind, labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != part:
                part, whole, open_prefixes = number, None, []
            while open_prefixes and not key.startswith(open_prefixes[-1][0]):
                open_prefixes.pop()
            if kind == _PREFIX:
                open_prefixes.append((key, labels))
            elif kind == _WHOLE:
                whole = key, labels
            elif whole and whole[0] == key:
                words.append(key)
                found.append(whole[1])
            elif open_prefixes:
                words.append(key)
                found.append(open_prefixes[-1][1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(found, pa.list_(pa.string()))], ["word", "labels"])


def match_by_sweep(words: DataFrame, stems: DataFrame, ranges: int | None = None) -> DataFrame:
    """``word, labels`` of the words that match: the whole word first, then the longest prefix.

    ``words`` holds distinct words, ``stems`` one row per pattern, ``stem, is_prefix, labels``. Each word is
    shuffled once. A prefix that spans ranges is sent to each, so there are at most as many copies as
    patterns, and for each bound the prefixes of one word.
    """
    spark = words.sparkSession
    ship_package(spark)
    words = words.filter(F.col("word").isNotNull())
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(words, ranges)
    shared = spark.sparkContext.broadcast(bounds)  # fewer than ranges

    def first_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bisect_right(shared.value, w) for w in batch.column("word").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column("word")], ["part", "word"])

    def all_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for stem, is_prefix in zip(batch.column("stem").cast(pa.binary()).to_pylist(), batch.column("is_prefix").to_pylist(), strict=True):
                first = bisect_right(shared.value, stem)
                last = bisect_right(shared.value, stem + _BEHIND) if is_prefix else first
                parts.append(list(range(first, last + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.int32())), *batch.columns], ["parts", "stem", "is_prefix", "labels"])

    placed = words.select("word").mapInArrow(first_part, "part int, word string")
    kinds = F.when(F.col("is_prefix"), _PREFIX).otherwise(_WHOLE)
    patterns = (
        stems.select("stem", "is_prefix", "labels")
        .mapInArrow(all_parts, "parts array<int>, stem string, is_prefix boolean, labels array<string>")
        .select(F.explode("parts").alias("part"), F.col("stem").alias("key"), kinds.alias("kind"), "labels")
    )
    none = F.lit(None).cast("array<string>")
    rows = placed.select("part", F.col("word").alias("key"), F.lit(_WORD).alias("kind"), none.alias("labels")).unionByName(patterns)
    sorted_rows = rows.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")
    return sorted_rows.mapInArrow(sweep, "word string, labels array<string>")


def distinct_words(entries: DataFrame) -> DataFrame:
    """The words of entries in lower case, once each, written once as they are used twice."""
    words = entries.select(F.lower("word").alias("word")).filter(F.col("word").isNotNull()).distinct()
    return stage(words, "distinct-words")

"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

A ``LineIndex`` is a folder with one sub-folder per change. The exact tables say
which document holds which line (by a 128-bit hash of the line's key): ``refs``
has the pairs a change added, ``gone`` the documents it took out, ``counts`` how
many documents hold each key and the smallest of them. Beside them lie the
filters: the keys are dealt to shards by their hash, and each shard has cuckoo
filters of 16-bit marks, which, unlike Bloom filters, can take keys out again. A
batch that is inserted asks the filters first: keys they do not know are new and
meet no older table; only the rest is joined with the exact counts. When a
document is deleted, counts go down, and keys without holders leave the filters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.llm.common import SPACES, by_size, byte_pieces, filled
from termtide.operators.joins import lookup_join
from termtide.session import scratch_path, stage

MIN_KEY = 10  # code points
KEYS_PER_SHARD = 1 << 17
_STRIP = SPACES.encode()
_SLOTS = 4
_KICKS = 500
# Share of its slots up to which a filter takes keys in; above it kicks get long.
_FULL = 0.9
# Batches by which the documents of a new index go in.
BATCHES = 2


def line_keys(text: bytes) -> list[bytes | None]:
    """A 16-byte hash for each line; None for keys of fewer than ``MIN_KEY`` code points."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP).lower()  # bytes: A-Z only
        if len(key) < MIN_KEY or len(key) < 4 * MIN_KEY and len(key.decode("utf8", "replace")) < MIN_KEY:
            keys.append(None)
        else:
            keys.append(xxhash.xxh3_128_digest(key))
    return keys


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text"):
        data, offsets = byte_pieces(batch.column("text"))
        data = data.tobytes()
        rows, keys = [], []
        for i in range(batch.num_rows):
            own = set(line_keys(data[offsets[i] : offsets[i + 1]]))
            own.discard(None)
            rows += [i] * len(own)
            keys += own
        halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc_id").take(pa.array(rows, pa.int64()))],
            ["k1", "k2", "doc_id"],
        )


def line_pairs(docs: DataFrame) -> DataFrame:
    """``k1, k2, doc_id``: each key of each document once (``docs`` has ``doc_id, text``)."""
    return docs.mapInArrow(_pairs, "k1 bigint, k2 bigint, doc_id bigint")


# --- cuckoo filters -------------------------------------------------------------


class CuckooFilter:
    """Marks of 16 bits in buckets of four slots; takes keys in and out again."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(keys / (_SLOTS * 0.8))) - 1).bit_length()
        return cls(np.zeros((buckets, _SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy())

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mark, first and second bucket of 64-bit hashes."""
        h = keys.astype(np.uint64)
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (len(self.table) - 1)
        return mark, first, self.other(first, mark)

    def other(self, bucket, mark):
        """The mark's other bucket; of the other, the one given."""
        return (bucket ^ (np.asarray(mark, np.int64) * 0x5BD1E995)) & (len(self.table) - 1)

    def __contains__(self, key: int) -> bool:
        return bool(self.known(np.array([key], np.int64))[0])

    def known(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(keys)
        same = mark[:, None]
        return (self.table[first] == same).any(axis=1) | (self.table[second] == same).any(axis=1)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Puts the keys in; returns those for which there was no room."""
        mark, first, second = self.places(keys)
        left = np.arange(len(keys))
        for bucket in (first, second):  # in bulk: the r-th newcomer of a bucket takes its r-th free slot
            if not len(left):
                break
            order = left[np.argsort(bucket[left], kind="stable")]
            at = bucket[order]
            new = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            free = np.argsort(self.table[at] != 0, axis=1, kind="stable")
            fits = rank < (self.table[at] == 0).sum(axis=1)
            self.table[at[fits], free[fits, rank[fits]]] = mark[order[fits]]
            left = order[~fits]
        failed = [i for i in left if not self._kick(int(mark[i]), int(first[i]))]
        return keys[failed]

    def _kick(self, mark: int, bucket: int) -> bool:
        """Moves marks between their two buckets until one is free; else puts all back."""
        moved = []
        for step in range(_KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return True
            slot = (step * 7 + mark) % _SLOTS
            moved.append((bucket, slot))
            mark, row[slot] = int(row[slot]), mark
            bucket = int(self.other(bucket, mark))
        for bucket, slot in reversed(moved):
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
        return False

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Takes out one mark for each key; returns keys that were not found."""
        mark, first, second = self.places(keys)
        missing = []
        for i in range(len(keys)):
            for bucket in (first[i], second[i]):
                slots = np.flatnonzero(self.table[bucket] == mark[i])
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break
            else:
                missing.append(i)
        return keys[missing]


def _key64(k1: pd.Series, k2: pd.Series) -> np.ndarray:
    return k1.to_numpy(np.int64) ^ (k2.to_numpy(np.int64) >> 1)


def _updated(segments: list[bytes], new: np.ndarray, old: np.ndarray) -> list[bytes]:
    """A shard's filters after taking keys in and out. A full shard gets a further filter.

    A key goes from the largest filter that has its mark. If that mark is another
    key's, the two share mark and buckets there, and so in every smaller filter, as
    buckets are the low bits of the same number: the mark left there serves the other key.
    """
    filters = [CuckooFilter.read(s) for s in segments]
    for f in sorted(filters, key=lambda f: -len(f.table)):
        if len(old):
            old = f.delete(old)
    for f in reversed(filters):
        room = max(0, int(_FULL * f.table.size) - np.count_nonzero(f.table))
        if len(new) and room:
            new = np.concatenate([f.insert(new[:room]), new[room:]])
    while len(new):
        filters.append(CuckooFilter.sized(max(1024, len(new))))
        new = filters[-1].insert(new)
    return [f.table.tobytes() for f in filters]


_FILTERS = "shard int, segment int, data binary"


def _apply_changes(key, changes: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    keys = _key64(changes.k1, changes.k2)
    added = changes.added.to_numpy(bool)
    segments = _updated(list(filters.sort_values("segment").data), keys[added], keys[~added])
    return pd.DataFrame({"shard": np.int32(key[0]), "segment": np.arange(len(segments), dtype=np.int32), "data": segments})


def _ask(key, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hashes = _key64(keys.k1, keys.k2)
    found = np.zeros(len(keys), bool)
    for data in filters.data:
        found |= CuckooFilter.read(data).known(hashes)
    return keys.assign(maybe=found).drop(columns="shard")


class LineIndex:
    """Which document holds which line; see the head of the file.

    ``docs`` have ``doc_id`` (not null, once in the index) and ``text``; further
    columns do no harm. A null or empty text has one empty line. Every change
    writes new tables and leaves the earlier ones as they are.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self.changes = 0

    @classmethod
    def for_documents(cls, spark: SparkSession, path: str, lines: int) -> LineIndex:
        """An index whose shards have about ``KEYS_PER_SHARD`` keys for so many lines."""
        return cls(spark, path, max(8, -(-lines // KEYS_PER_SHARD)))

    def _write(self, df: DataFrame, what: str, change: int) -> None:
        df.write.mode("errorifexists").parquet(f"{self.path}/{what}/{change}")

    def _read(self, what: str, change: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{what}/{change}")

    def _shard(self):
        return F.pmod(F.col("k1"), F.lit(self.shards)).cast("int").alias("shard")

    def counts(self) -> DataFrame:
        """``k1, k2, holders, first_doc`` of all keys that any document holds."""
        if not self.changes:
            return self.spark.createDataFrame([], "k1 bigint, k2 bigint, holders bigint, first_doc bigint")
        return self._read("counts", self.changes)

    def filters(self) -> DataFrame:
        if not self.changes:
            return self.spark.createDataFrame([], _FILTERS)
        return self._read("filters", self.changes)

    def refs(self) -> DataFrame:
        """``k1, k2, doc_id`` of the documents now in the index."""
        live = self.spark.createDataFrame([], "k1 bigint, k2 bigint, doc_id bigint")
        for change in range(1, self.changes + 1):
            if change in self._gone:
                live = live.join(self._read("gone", change), "doc_id", "left_anti")
            else:
                live = live.unionByName(self._read("refs", change)) if change > 1 else self._read("refs", change)
        return live

    @property
    def _gone(self) -> set[int]:
        return self.__dict__.setdefault("_gone_changes", set())

    def known(self, keys: DataFrame) -> DataFrame:
        """``keys`` (``k1, k2`` and more) with ``maybe``: false if no document holds the key."""
        if not self.changes:
            return keys.withColumn("maybe", F.lit(False))
        columns = [f for f in keys.schema.fields]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", maybe boolean"
        sharded = keys.withColumn("shard", F.pmod("k1", F.lit(self.shards)).cast("int"))
        return sharded.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(_ask, schema)

    def _write_filters(self, changed: DataFrame, change: int) -> None:
        """``changed``: ``k1, k2, added`` of keys that came or went."""
        if change > 1:
            older = self._read("filters", change - 1)
        else:
            older = self.spark.createDataFrame([], _FILTERS)
        sharded = changed.select("k1", "k2", "added", self._shard())
        new = sharded.groupBy("shard").cogroup(older.groupBy("shard")).applyInPandas(_apply_changes, _FILTERS)
        self._write(new, "filters", change)

    def insert(self, docs: DataFrame) -> None:
        """Takes documents in."""
        change = self.changes + 1
        self._write(line_pairs(docs.select("doc_id", filled("text").alias("text"))), "refs", change)
        batch = self._read("refs", change).groupBy("k1", "k2").agg(
            F.count(F.lit(1)).alias("holders"), F.min("doc_id").alias("first_doc")
        )
        if not self.changes:
            self._write(batch, "counts", change)
            new = self._read("counts", change)
        else:
            asked = stage(self.known(batch), "line-keys")
            maybe = asked.filter("maybe").drop("maybe")
            old = self.counts().select("k1", "k2", F.col("holders").alias("_n"), F.col("first_doc").alias("_first"))
            both = stage(maybe.join(old, ["k1", "k2"], "left"), "line-known")
            summed = both.select(
                "k1",
                "k2",
                (F.col("holders") + F.coalesce("_n", F.lit(0))).alias("holders"),
                F.least("first_doc", "_first").alias("first_doc"),
            )
            fresh = asked.filter("not maybe").drop("maybe")
            untouched = self.counts().join(maybe, ["k1", "k2"], "left_anti")
            self._write(untouched.unionByName(summed).unionByName(fresh), "counts", change)
            new = fresh.unionByName(both.filter("_n is null").select(*fresh.columns))
        self._write_filters(new.select("k1", "k2", F.lit(True).alias("added")), change)
        self.changes = change

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents with these ``doc_id`` out; unknown ones do nothing."""
        change = self.changes + 1
        gone = stage(ids.select("doc_id").distinct(), "line-gone")
        taken = self.refs().join(gone, "doc_id", "left_semi")
        lost = stage(taken.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("lost")), "line-lost")
        rest = self.refs().join(gone, "doc_id", "left_anti")
        left = lookup_join(rest, lost.select("k1", "k2"), ["k1", "k2"], "left_semi")
        first = left.groupBy("k1", "k2").agg(F.min("doc_id").alias("_first"))
        counts = self.counts()
        touched = counts.join(lost, ["k1", "k2"]).join(first, ["k1", "k2"], "left")
        touched = stage(touched, "line-touched")
        now = touched.select("k1", "k2", (F.col("holders") - F.col("lost")).alias("holders"), F.col("_first").alias("first_doc"))
        untouched = counts.join(lost, ["k1", "k2"], "left_anti")
        self._write(untouched.unionByName(now.filter("holders > 0")), "counts", change)
        self._write(gone, "gone", change)
        self._write_filters(now.filter("holders = 0").select("k1", "k2", F.lit(False).alias("added")), change)
        # shards without a change keep their filters
        self._gone.add(change)
        self.changes = change

    def dropped_keys(self) -> DataFrame:
        """``doc_id, dropped``: the keys each document loses, as 16-byte values in one binary."""
        repeated = self.counts().filter("holders > 1").select("k1", "k2", "first_doc")
        lost = lookup_join(self.refs(), repeated, ["k1", "k2"], "inner").filter("doc_id <> first_doc")
        # at most as many keys as the document has lines
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("dropped"))

    def rewrite(self, docs: DataFrame) -> DataFrame:
        """``doc_id, text, n_lines, n_dropped`` of documents in the index.

        Lines whose key two or more documents hold stay only in the one with the
        smallest id (there all of them); the others lose them. What stays is
        joined by line feeds.
        """
        own = docs.select("doc_id", filled("text").alias("text"))
        joined = own.join(self.dropped_keys(), "doc_id", "left")
        return joined.mapInArrow(_rewritten, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text"):
        data, offsets = byte_pieces(batch.column("text"))
        data = data.tobytes()
        texts, n_lines, n_dropped = [], [], []
        lists = batch.column("dropped")
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            total = text.count(b"\n") + 1
            if lists[i].is_valid:
                pairs = lists[i].values
                halves = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], axis=1).astype("<i8")
                raw = halves.tobytes()
                gone = {raw[j : j + 16] for j in range(0, len(raw), 16)}
                kept = [line for line, k in zip(text.split(b"\n"), line_keys(text), strict=True) if k not in gone]
                text = b"\n".join(kept)
                n_dropped.append(total - len(kept))
            else:
                n_dropped.append(0)
            texts.append(text)
            n_lines.append(total)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            ["doc_id", "text", "n_lines", "n_dropped"],
        )


def dedup_lines(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` after inserting all documents into a new index.

    They go in by ``BATCHES`` batches; all but the first come through the filters.
    """
    spark = docs.sparkSession
    index = LineIndex.for_documents(spark, path or scratch_path(spark, "lines"), 16 * docs.count())
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
    for number in range(BATCHES):
        index.insert(docs.filter(batch == number))
    return index.rewrite(docs)

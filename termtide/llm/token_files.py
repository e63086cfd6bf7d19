"""Token ids in files of independent zstandard frames.

A file is a run of frames, each readable without the others, then two skippable
frames, so that any zstandard reader can decompress the ids as one stream of
little-endian unsigned 32-bit integers:

* an index of the documents: count, then ``doc_id`` (int64) and the number of ids
  (uint64) of each, in the order of the file, itself compressed;
* the seek table of the public seekable format: for each frame its compressed and
  decompressed size and the low 32 bits of the XXH64 of its content, then the
  number of frames, a descriptor byte and the magic number.

A reader takes the tail of the file, finds the frames that cover the documents it
wants, and decompresses and verifies only these.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termtide.llm import tokens
from termtide.session import scratch_path, stage

FRAME_BYTES = 1 << 20  # of ids before compression
# Fixed values of the zstandard formats.
_SKIPPABLE, _SEEK_TABLE, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path within it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class TokenWriter:
    """Writes documents' ids, in the order given, to an open binary stream."""

    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.pending, self.size = [], 0
        self.frames, self.docs, self.counts = [], [], []

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.pending.append(ids)
        self.size += len(ids)
        while self.size >= self.frame_bytes:  # a long document goes over several frames
            data = b"".join(self.pending)
            self._frame(data[: self.frame_bytes])
            self.pending, self.size = [data[self.frame_bytes :]], len(data) - self.frame_bytes

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.pending))
        index = np.array([self.docs, self.counts], "<i8").tobytes()
        packed = struct.pack("<QI", len(self.docs), xxhash.xxh64_intdigest(index) & 0xFFFFFFFF) + self.compressor.compress(index)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), _CHECKSUMS, _SEEKABLE)
        self.out.write(struct.pack("<II", _SEEK_TABLE, len(table)) + table)


class TokenReader:
    """Reads documents' ids from a seekable binary stream of ``size`` bytes."""

    def __init__(self, stream, size: int):
        self.stream = stream
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE or flags != _CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.begins = np.append(0, np.cumsum(table[:, 0]))
        self.offsets = np.append(0, np.cumsum(table[:, 1]))
        self.checks = table[:, 2]
        after = int(self.begins[-1])
        magic, length = struct.unpack("<II", self._at(after, 8))
        if magic != _SKIPPABLE:
            raise ValueError("no index of documents behind the frames")
        packed = self._at(after + 8, length)
        docs, check = struct.unpack("<QI", packed[:12])
        index = zstandard.ZstdDecompressor().decompress(packed[12:], max_output_size=max(16 * docs, 1))
        if xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != check:
            raise ValueError("the index of documents is damaged")
        self.doc_ids, self.counts = np.frombuffer(index, "<i8").reshape(2, docs)
        self.starts = np.append(0, np.cumsum(self.counts))
        self._frame_no, self._frame_data = -1, b""

    def _at(self, offset: int, length: int) -> bytes:
        if offset < 0:
            raise ValueError("the file is too short")
        self.stream.seek(offset)
        return self.stream.read(length)

    def _frame(self, number: int) -> bytes:
        if number != self._frame_no:
            packed = self._at(int(self.begins[number]), int(self.begins[number + 1] - self.begins[number]))
            data = zstandard.ZstdDecompressor().decompress(packed)
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[number]:
                raise ValueError(f"frame {number} is damaged")
            self._frame_no, self._frame_data = number, data
        return self._frame_data

    def ids(self, place: int) -> bytes:
        """The ids of the document at a place of the index, as bytes."""
        low, high = int(self.starts[place]) * 4, int(self.starts[place + 1]) * 4
        if low == high:
            return b""
        first = int(np.searchsorted(self.offsets, low, side="right")) - 1
        parts = []
        while low < high:
            begin, end = int(self.offsets[first]), int(self.offsets[first + 1])
            parts.append(self._frame(first)[low - begin : high - begin])
            low, first = end, first + 1
        return b"".join(parts)


_FILES = "part int, path string, n_docs bigint, n_tokens bigint"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Writes the ids of every text, by ascending id, and returns a row for each file: ``part, path,
    n_docs, n_tokens, first`` (``first``: ids in the files before it).

    The texts are range-partitioned by id and one task writes one file, under a name
    of its own; only files named in the returned table belong to the set, so a task
    that runs twice leaves an unnamed file behind and nothing else. A null text
    counts as empty and has the end id alone. Rows with the same id stay side by
    side; a row without id comes first, with the smallest 64-bit number as its id.
    An empty table gives no files.
    """
    narrow = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("doc_id"), F.col(text).alias("text")
    )
    n = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = narrow.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    root = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        store, inner = filesystem(name)
        writer = out = None
        for batch in tokens.slices(batches, "text"):
            if writer is None:
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(inner, compression=None)
                writer = TokenWriter(out)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encoded(batch, "text", vocabulary), strict=True):
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            out.close()
            row = [[part], [name], [len(writer.docs)], [sum(writer.counts)]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "path", "n_docs", "n_tokens"]
            )

    files = stage(ordered.mapInArrow(write, _FILES), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one small row a file
    return files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents of the files, or of the ``wanted`` ids only:
    then only the frames that hold them are decompressed."""
    keep = None if wanted is None else np.unique(np.array(wanted, np.int64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                store, inner = filesystem(path)
                with store.open_input_file(inner) as stream:
                    reader = TokenReader(stream, stream.size())
                    places = np.arange(len(reader.doc_ids))
                    if keep is not None:
                        places = places[np.isin(reader.doc_ids, keep)]
                    for low in range(0, len(places), 512):
                        part = places[low : low + 512]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.doc_ids[part]),
                                pa.array(reader.starts[part] + first),
                                pa.array(reader.counts[part]),
                                pa.array([reader.ids(p) for p in part], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    spread = files.select("path", "first").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_path(docs: DataFrame) -> str:
    """A new folder for token files below the shared one."""
    return scratch_path(docs.sparkSession, "token-ids")

"""Removal of repeated byte strings, decided by suffix arrays.

A byte goes that lies in a string of ``LENGTH`` bytes that also starts earlier: in a
document of smaller id, or earlier in the same one. The texts of a corpus make no
single suffix array, so the strings are dealt out first, by content:

1. Every string of ``LENGTH`` bytes is represented by the ``GRAM``-byte piece in it
   with the smallest hash. Neighbouring strings share theirs; a run of them is one
   chunk of text. Equal strings have the same piece, at the same place, and meet.
2. Chunks that repeat whole are told by 128 bits, the hashes of the piece and of the
   chunk: each but the first goes. What repeats within a slice of texts is decided where
   it is read, so that a slice sends on one chunk of a kind; the others meet in one
   shuffle, by ranges of both hashes, which parts neither a kind of chunk nor, but at the
   ends of the ranges, the kinds around a piece.
3. Pieces around which there is one chunk only hold nothing else that repeats.
4. What is left are first occurrences of different chunks around the same piece. They
   are cut to what any other of the group has in common with them, and equal cuts are
   joined. Over the rest of a task's groups a suffix array is built by grouping
   (``suffix_sort``); strings whose suffixes share ``LENGTH`` bytes lie side by side
   in it, and each but the first goes.

Groups of more than ``GROUP_CHUNKS`` different chunks are not gathered in one task:
their strings are compared one by one by 128-bit hashes, in an aggregation that
combines before its shuffle, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termtide.llm.common import by_size, byte_pieces, released, text_batches
from termtide.llm.suffix_sort import suffix_array
from termtide.llm.ordering import own_ids
from termtide.operators.joins import lookup_join
from termtide.session import stage

LENGTH = 100
GRAM = 32
GROUP_CHUNKS = 1 << 16
# Bytes of the strings that go into one suffix array, but for a group that alone has more.
ARRAY_BYTES = 400_000
_SLICE = 1 << 20
_ROWS = 1 << 16  # chunks looked at together
_NO_ID = -(1 << 63)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place."""
    u = np.uint64
    x = data.astype(np.uint64)
    x = x[:-1] | (x[1:] << u(8))
    x = x[:-2] | (x[2:] << u(16))
    x = x[:-4] | (x[4:] << u(32))
    x *= _C1
    x ^= x >> u(29)
    x = x[:-8] * _C2 + x[8:]
    x ^= x >> u(32)
    x *= _C3
    x = x[:-16] * _C2 + x[16:]
    x ^= x >> u(31)
    x *= _C1
    x ^= x >> u(30)
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each ``width`` neighbours, of equal ones the rightmost."""
    place = np.arange(len(x))

    def merged(gap: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = x[: len(x) - gap], x[gap:]
        return np.minimum(left, right), np.where(right <= left, place[gap:], place[: len(place) - gap])

    step = 1
    while step * 2 <= width:
        x, place = merged(step)
        step *= 2
    return merged(width - step)[1] if step < width else place


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with the same piece: hash of the piece, first string, one past the last string's end,
    place of the piece, and text, as arrays; places within ``data``."""
    none = (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 4
    if len(data) < LENGTH:
        return none
    hashes = _gram_hashes(data)
    least = _least(hashes, LENGTH - GRAM + 1)
    starts = np.arange(len(least))
    text = np.searchsorted(offsets, starts, side="right") - 1
    valid = starts + LENGTH <= offsets[text + 1]
    change = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
    change |= valid != np.r_[False, valid[:-1]]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(least)] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    piece = least[first]
    return hashes[piece], first, last + LENGTH, piece, text[first]


_CHUNKS = "key bigint, whole bigint, doc_id bigint, start int, ahead int, size int"
_GONE = -1  # ``ahead`` of what is known to go; such a row has no piece
_NAMES = ["key", "whole", "doc_id", "start", "ahead", "size"]


def _slice_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first chunk of each kind in a slice of texts. The later ones go, as spans with any ``key``,
    those that touch as one."""
    for batch in by_size(batches, "text", _SLICE):
        data, offsets = byte_pieces(batch.column("text"))
        key, begin, end, piece, text = chunks(data, offsets)
        view = memoryview(data)
        whole = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64)
        doc = batch.column("doc_id").to_numpy()[text]
        order = np.lexsort((begin - offsets[text], doc, whole, key))
        gone = np.zeros(len(key), bool)
        gone[order[1:]] = (key[order][1:] == key[order][:-1]) & (whole[order][1:] == whole[order][:-1])
        # both ends of the chunks of a text ascend
        later, stay = np.flatnonzero(gone), ~gone
        apart = (text[later][1:] != text[later][:-1]) | (begin[later][1:] > end[later][:-1])
        head, tail = later[np.r_[True, apart][: len(later)]], later[np.r_[apart, True][: len(later)]]
        start, ahead, size = begin - offsets[text], piece - begin, end - begin
        columns = [
            np.append(key[stay], (whole[head] + begin[head].astype(np.uint64) * _C1) * _C2).view(np.int64),
            np.append(whole[stay], whole[head]).view(np.int64),
            np.append(doc[stay], doc[head]),
            np.append(start[stay], start[head]).astype(np.int32),
            np.append(ahead[stay], np.full(len(head), _GONE)).astype(np.int32),
            np.append(size[stay], end[tail] - begin[head]).astype(np.int32),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _NAMES)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of some ``_ROWS`` rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _ROWS:
            yield [np.concatenate([b.column(c).to_numpy() for b in held]) for c in _NAMES]
            held, rows = [], 0
    if rows:
        yield [np.concatenate([b.column(c).to_numpy() for b in held]) for c in _NAMES]


def _placed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of chunks, sorted: those that go, and the first ones of each kind where there is another kind
    around the piece. The range may have parted its first and its last piece from others of their kinds, so these stay too."""

    def rows(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _NAMES)

    last: tuple | None = None  # key and hash of the row before
    held: list[np.ndarray] | None = None  # the first chunk before, of which the next one is not known
    wanted = True  # whether it stays whatever comes next; the first of the range does
    for columns in _gathered(batches):
        known = columns[4] == _GONE
        yield rows([c[known] for c in columns])
        key, whole, doc, start, ahead, size = columns = [c[~known] for c in columns]
        if not len(key):
            continue
        new = np.r_[last != (key[0], whole[0]), (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])]
        last = key[-1], whole[-1]
        yield rows([key[~new], whole[~new], doc[~new], start[~new], np.full_like(ahead[~new], _GONE), size[~new]])
        first = [c[new] for c in columns]
        if held is not None:
            first = [np.append(h, c) for h, c in zip(held, first, strict=True)]
        if not len(first[0]):
            continue
        same = first[0][1:] == first[0][:-1]
        mixed = np.r_[wanted, same] | np.r_[same, False]
        yield rows([c[:-1][mixed[:-1]] for c in first])
        held, wanted = [c[-1:] for c in first], bool(mixed[-1])
    if held is not None:
        yield rows(held)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks listed for each document."""
    for batch in by_size(batches, "text", _SLICE):
        data, offsets = byte_pieces(batch.column("text"))
        lists = batch.column("chunks")
        counts = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), counts)
        inner = lists.flatten()
        key, start, ahead, size = (inner.field(i).to_numpy() for i in range(4))
        begin = start + offsets[row]
        view = memoryview(data)
        parts = [bytes(view[a : a + s]) for a, s in zip(begin.tolist(), size.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(ahead), pa.array(parts, pa.binary())],
            ["key", "doc_id", "start", "ahead", "data"],
        )


_SPANS = "doc_id bigint, start int, size int"


def _shared(group: np.ndarray, parts: list[bytes], width: int) -> np.ndarray:
    """How many first bytes each part has in common with some other part of its group."""
    table = np.zeros((len(parts), width), np.uint8)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table[np.repeat(np.arange(len(parts)), sizes), inner] = flat + 1  # UTF-8 has no byte 255; 0 is past the end
    names = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4) + 0, table], axis=1)
    order = np.argsort(np.ascontiguousarray(names).view(f"S{width + 4}").ravel(), kind="stable")
    sorted_ = table[order]
    same = (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] > 0)
    common = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    common[group[order][1:] != group[order][:-1]] = 0
    best = np.maximum(np.append(0, common), np.append(common, 0))
    out = np.zeros(len(parts), np.int64)
    out[order] = best
    return out


def repeated_windows(strings: list[bytes], origin: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each string, which of its ``LENGTH``-byte windows also start earlier: in an ``origin``
    (document, place) before their own. By the suffix array of all strings."""
    sizes = np.array([len(s) for s in strings])
    text = b"\xff".join(strings) + b"\xff"  # a byte that UTF-8 has not
    order = np.array(suffix_array(text), np.int64)
    begins = np.append(0, np.cumsum(sizes + 1))
    which = np.searchsorted(begins, order, side="right") - 1
    inner = order - begins[which]
    whole = inner + LENGTH <= sizes[which]
    order, which, inner = order[whole], which[whole], inner[whole]
    flags = [np.zeros(max(0, s - LENGTH + 1), bool) for s in sizes]
    if len(order) < 2:
        return flags
    data = np.frombuffer(text, np.uint8)
    same = np.ones(len(order) - 1, bool)
    for k in range(LENGTH):
        same &= data[order[1:] + k] == data[order[:-1] + k]
    label = np.cumsum(np.r_[True, ~same]) - 1
    doc = np.array([o[0] for o in origin], np.int64)[which]
    at = np.array([o[1] for o in origin], np.int64)[which] + inner
    ranked = np.lexsort((at, doc, label))
    later = np.r_[False, label[ranked][1:] == label[ranked][:-1]]
    for w, i in zip(which[ranked][later].tolist(), inner[ranked][later].tolist(), strict=True):
        flags[w][i] = True
    return flags


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First place and length in bytes of the runs of windows."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [(int(a), int(b - a + LENGTH - 1)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _spans_of(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """Removed spans of the different chunks of some groups; rows: ``key, doc_id, start, ahead, data``."""
    group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
    left = _shared(group, [r[4][: r[3]][::-1] for r in rows], LENGTH)
    right = _shared(group, [r[4][r[3] :] for r in rows], LENGTH)
    spans: list[tuple[int, int, int]] = []
    cuts: dict[tuple, list[tuple[int, int]]] = {}
    for i in np.flatnonzero(left + right >= LENGTH).tolist():
        key, doc, start, ahead, data = rows[i]
        begin = ahead - int(left[i])
        cut = data[begin : ahead + int(right[i])]
        cuts.setdefault((int(group[i]), cut), []).append((doc, start + begin))
    strings: list[tuple[int, bytes, tuple[int, int]]] = []
    alone: dict[int, int] = {}
    for (g, cut), places in cuts.items():
        places.sort()
        spans += [(doc, start, len(cut)) for doc, start in places[1:]]
        strings.append((g, cut, places[0]))
        alone[g] = alone.get(g, 0) + 1
    strings = [s for s in strings if alone[s[0]] > 1]  # the only cut of its group has nothing before it
    if strings:
        found = repeated_windows([s[1] for s in strings], [s[2] for s in strings])
        for (_, _, (doc, start)), flags in zip(strings, found, strict=True):
            spans += [(doc, start + a, n) for a, n in _runs(flags)]
    return spans


def _array_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups, which follow each other, by suffix arrays of about ``ARRAY_BYTES``."""
    rows: list[tuple] = []
    size = 0

    def done() -> pa.RecordBatch:
        spans = np.array(_spans_of(rows), np.int64).reshape(-1, 3)
        columns = [pa.array(spans[:, 0]), pa.array(spans[:, 1].astype(np.int32)), pa.array(spans[:, 2].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "size"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "start", "ahead", "data")), strict=True):
            if size > ARRAY_BYTES and row[0] != rows[-1][0]:
                yield done()
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield done()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the chunks of very large groups, by its hash."""
    for batch in batches:
        out: list[tuple[bytes, int, int]] = []
        for doc, start, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "data")), strict=True):
            out += [(xxhash.xxh3_128_digest(data[i : i + LENGTH]), doc, start + i) for i in range(len(data) - LENGTH + 1)]
        halves = np.frombuffer(b"".join(o[0] for o in out), "<i8").reshape(-1, 2)
        columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        columns += [pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["w1", "w2", "doc_id", "start"])


def _window_spans(fetched: DataFrame) -> DataFrame:
    windows = stage(fetched.mapInArrow(released(_window_rows), "w1 bigint, w2 bigint, doc_id bigint, start int"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("_f"), F.count(F.lit(1)).alias("n"))
    again = lookup_join(windows, first.filter("n > 1").drop("n"), ["w1", "w2"], "inner")
    later = again.filter((F.col("doc_id") != F.col("_f.doc_id")) | (F.col("start") != F.col("_f.start")))
    return later.select("doc_id", "start", F.lit(LENGTH).alias("size"))


def repeated_spans(docs: DataFrame, group_chunks: int = GROUP_CHUNKS) -> DataFrame:
    """``doc_id, start, size`` in bytes of what goes; spans of a document may overlap.

    ``docs`` has ``doc_id`` (once each) and ``text``. Further columns go with the texts to Python, so that a
    later join by ``doc_id`` with all of ``docs`` reuses the shuffle.
    """
    with text_batches(docs.sparkSession):
        found = docs.select("doc_id", "text").mapInArrow(released(_slice_chunks), _CHUNKS)
        sorted_ = found.repartitionByRange("key", "whole").sortWithinPartitions("key", "whole", "doc_id", "start")
        placed = stage(sorted_.mapInArrow(_placed_chunks, _CHUNKS), "placed-chunks")
    spans = placed.filter(F.col("ahead") == _GONE).select("doc_id", "start", "size")
    # different chunks around the same piece
    first = placed.filter(F.col("ahead") != _GONE).select("key", F.struct("doc_id", "start", "ahead", "size").alias("_f"))
    kinds = first.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    mixed = stage(lookup_join(first, kinds, ["key"], "inner"), "mixed-chunks")

    def fetched(some: DataFrame) -> DataFrame:
        listed = some.groupBy("_f.doc_id").agg(F.collect_list(F.struct("key", "_f.start", "_f.ahead", "_f.size")).alias("chunks"))
        return docs.join(listed, "doc_id").mapInArrow(released(_fetch), "key bigint, doc_id bigint, start int, ahead int, data binary")

    usual = fetched(mixed.filter(F.col("kinds") <= group_chunks)).repartition("key").sortWithinPartitions("key")
    spans = spans.unionByName(usual.mapInArrow(released(_array_spans), _SPANS))
    large = mixed.filter(F.col("kinds") > group_chunks)
    if large.head(1):
        spans = spans.unionByName(_window_spans(fetched(large)))
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text", _SLICE):
        data, offsets = byte_pieces(batch.column("text"))
        lists = batch.column("spans")
        kept, texts, removed, runs, digests = [], [], [], [], []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            n = k = 0
            if lists[i].is_valid:
                inner = lists[i].values
                start, size = inner.field(0).to_numpy().astype(np.int64), inner.field(1).to_numpy()
                edges = np.bincount(start, minlength=len(text) + 1) - np.bincount(start + size, minlength=len(text) + 1)
                gone = np.cumsum(edges)[:-1] > 0
                n, k = int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
                text = text[~gone]
            raw = text.tobytes()
            kept.append(raw)
            texts.append(raw.decode("utf8", "ignore") if n else None)
            removed.append(n)
            runs.append(k)
            digests.append(hashlib.sha256(raw).hexdigest())
        sizes = np.diff(offsets)
        columns = [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)]
        names = ["doc_id", "kept", "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if _ALSO in batch.schema.names:
            columns, names = [*columns, batch.column(_ALSO)], [*names, _ALSO]
        yield pa.RecordBatch.from_arrays(columns, names)


_ALSO = "also"


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", group_chunks: int = GROUP_CHUNKS, also: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, kept, kept_text, n_bytes, n_removed, n_spans, kept_sha256``: the bytes of each text that stay.

    ``kept_text`` is null if all stay, and else leaves out characters of which a part went. The columns of ``docs``
    named in ``also`` come as the fields of a struct ``also``, so that nobody needs to join them.

    A null text counts as empty; texts shorter than ``LENGTH`` bytes have nothing
    removed. Overlapping strings count, and all are judged on the input. A row without
    id comes before all others; rows that share an id come in the order of their texts. What stays
    of a text may begin or end within a character. An empty table gives no rows.
    """
    others = [F.struct(*[F.col(f"`{c}`") for c in also]).alias(_ALSO)] if also else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("_own"), F.col(text).alias("text"), *others)
    apart = own_ids(rows, "_own", "text", nulls_last=False)
    if apart is not None:
        rows, number = apart
        cut = drop_repeats(rows, number, "text", group_chunks, ["_own", *rows.columns[2:-1]])
        return cut.select(F.col(_ALSO)["_own"].alias("doc_id"), *cut.columns[1:-1], *[F.col(_ALSO)[_ALSO].alias(_ALSO) for _ in others])
    own = rows.select(
        F.coalesce("_own", F.lit(_NO_ID).cast("bigint")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *rows.columns[2:]
    )
    spans = repeated_spans(own, group_chunks).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = own.join(spans, "doc_id", "left")
    schema = "doc_id bigint, kept binary, kept_text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if also:
        schema = StructType([*StructType.fromDDL(schema), own.schema[_ALSO]])
    cut = joined.mapInArrow(released(_cut), schema)
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))

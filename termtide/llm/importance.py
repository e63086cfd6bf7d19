"""Importance resampling: documents drawn by how much their hashed n-grams look like a target's.

Features are runs of one to ``ngrams`` words; each falls into a bucket by the CRC-32 of its bytes. In a
slice of texts the distinct features of equal length make up a matrix of bytes, a row each, and all their
sums are updated column by column by table; they are then scattered back to the features' places. Rows
longer than ``SEGMENT`` are matrices of segments, joined by the table that moves a sum over a segment.

The corpus is read twice: once for the counts of all buckets, summed up in each task, and once
for the weights. The gain of each bucket is an integer, so that sums do not depend on their order; ``buckets``
of them (a parameter, not a function of the data) are broadcast. Scores add Gumbel noise from a digest of
the id: the highest scores are a draw without replacement. Ranks come from a range sort.

Defined results: a text without words (or null) has no features and weight 0; a null id counts as empty in
its noise and comes last among ties; repeated ids are rows of their own; an empty table draws nothing, an
empty target has gains all the same. Further columns are left out. Texts of any length are taken in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.llm.common import byte_pieces, by_size
from termtide.llm.ordering import numbered
from termtide.session import stage

BUCKETS = 10_000
SLICE_BYTES = 4 << 20
SEGMENT = 4096
_POLYNOMIAL = 0xEDB88320  # fixed value of the public CRC-32, bits reflected

# Bytes of words: digits, letters in lower case and all beyond ASCII; capitals are lowered before.
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return table


_TABLE = _crc_table()


def _columns(state: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sums after all bytes of a matrix, one column at a time."""
    for j in range(rows.shape[1]):
        state = _TABLE[(state ^ rows[:, j]) & 0xFF] ^ (state >> 8)
    return state


def _moves() -> np.ndarray:
    """What each byte of a sum becomes after ``SEGMENT`` zero bytes, ``[byte, value]``."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(SEGMENT):
        state = _TABLE[state & 0xFF] ^ (state >> 8)
    return state.reshape(4, 256)


def _matrix_sums(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes."""
    count, width = rows.shape
    state = np.full(count, 0xFFFFFFFF, np.uint32)
    if width <= 2 * SEGMENT:
        return ~_columns(state, rows)
    head = width % SEGMENT
    state = _columns(state, rows[:, :head])
    segments = rows[:, head:].reshape(-1, SEGMENT)
    parts = _columns(np.zeros(len(segments), np.uint32), segments).reshape(count, -1)
    moves = _moves()
    for k in range(parts.shape[1]):  # sums are linear: moved over a segment, then the segment's own
        state = moves[0][state & 0xFF] ^ moves[1][state >> 8 & 0xFF] ^ moves[2][state >> 16 & 0xFF] ^ moves[3][state >> 24] ^ parts[:, k]
    return ~state


def crc32_of(values: pa.Array) -> np.ndarray:
    """Unsigned CRC-32 of each binary value; values of one length go through one matrix."""
    lengths = np.diff(byte_pieces(values)[1])
    order = np.argsort(lengths, kind="stable")
    data, _ = byte_pieces(values.take(pa.array(order)))
    sums = np.empty(len(lengths), np.uint32)
    sizes, counts = np.unique(lengths, return_counts=True)
    row = byte = 0
    for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
        matrix = data[byte : byte + size * count].reshape(count, size)
        sums[order[row : row + count]] = _matrix_sums(matrix)
        row, byte = row + count, byte + size * count
    return sums


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (their bytes, lowered, and where each text starts) and which text each is of."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its text
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return _binary(np.concatenate([[0], np.cumsum(ends - starts)]), data[inside]), owner


def bucket_places(
    data: np.ndarray, offsets: np.ndarray, skip: np.ndarray, ngrams: int, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature of some texts, the text it is of, and the words of each text.

    ``skip`` is the number of leading words of each text whose features were counted before: only
    features that end behind them count.
    """
    words, owner = words_of(data, offsets)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(skip), np.int64)
    coded = words.dictionary_encode()
    of_word, known = coded.indices.to_numpy(), coded.dictionary
    within = np.arange(len(owner)) - np.searchsorted(owner, owner)  # the word's number in its text
    fresh = within >= skip[owner]
    places, owners = [], []
    of_run, runs = of_word.astype(np.int64), known
    for size in range(1, ngrams + 1):
        ends = np.flatnonzero((within >= size - 1) & fresh)
        found = crc32_of(runs) % buckets
        places.append(found[of_run[ends - (size - 1)]].astype(np.int64))
        owners.append(owner[ends])
        if size == ngrams:
            break
        # a run of one word more: distinct pairs of a run and the word behind it
        pairs = of_run[: len(owner) - size] * len(known) + of_word[size:]
        inner = owner[: len(owner) - size] == owner[size:]
        codes, distinct = pd.factorize(pairs[inner])
        of_run = np.full(len(owner), -1, np.int64)
        of_run[: len(pairs)][inner] = codes
        left = runs.take(pa.array(distinct // len(known)))
        runs = _joined(left, known.take(pa.array(distinct % len(known))))
    return np.concatenate(places), np.concatenate(owners), np.bincount(owners[0], minlength=len(skip))


def _joined(left: pa.Array, right: pa.Array) -> pa.Array:
    """Each left value, a blank and the right one."""
    a, a_at = byte_pieces(left)
    b, b_at = byte_pieces(right)
    a_size, b_size = np.diff(a_at), np.diff(b_at)
    offsets = np.concatenate([[0], np.cumsum(a_size + b_size + 1)])
    out = np.full(offsets[-1], 32, np.uint8)
    out[np.arange(len(a)) + np.repeat(offsets[:-1] - a_at[:-1], a_size)] = a
    out[np.arange(len(b)) + np.repeat(offsets[:-1] + a_size + 1 - b_at[:-1], b_size)] = b
    return _binary(offsets, out)


def _text_slices(data: np.ndarray, ngrams: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in slices that end between words, each led by the last words of the one before and their number."""
    carried, start = np.zeros(0, np.uint8), 0
    while start < len(data):
        end = min(start + SLICE_BYTES, len(data))
        while end < len(data) and _IN_WORD[data[end - 1]] and _IN_WORD[data[end]]:
            gap = np.flatnonzero(~_IN_WORD[data[end : end + SLICE_BYTES]])
            end = end + int(gap[0]) if len(gap) else min(end + SLICE_BYTES, len(data))
        part = data[start:end]
        led = np.concatenate([carried, part])
        words, _ = words_of(carried, np.array([0, len(carried)]))
        yield led, len(words)
        every, _ = words_of(led, np.array([0, len(led)]))
        last = every.slice(max(len(every) - (ngrams - 1), 0)) if ngrams > 1 else every.slice(len(every))
        carried = np.frombuffer(b"".join(w + b" " for w in last.to_pylist()), np.uint8)
        start = end


def batch_buckets(column: pa.Array, ngrams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``bucket_places`` of a column of texts, a long one in several goes."""
    data, offsets = byte_pieces(column)
    data = _LOWERED[data]
    if len(column) > 1 or len(data) <= 2 * SLICE_BYTES:
        yield bucket_places(data, offsets, np.zeros(len(column), np.int64), ngrams, buckets)
        return
    for part, known in _text_slices(data, ngrams):
        yield bucket_places(part, np.array([0, len(part)]), np.array([known]), ngrams, buckets)


def bucket_counts(docs: DataFrame, text: str, ngrams: int, buckets: int) -> DataFrame:
    """``bucket, n``: features of all texts in each bucket that has any; a task sends each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in by_size(batches, text, SLICE_BYTES):
            for places, *_ in batch_buckets(batch.column(text), ngrams, buckets):
                total += np.bincount(places, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    return docs.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, ngrams: int, buckets: int) -> np.ndarray:
    """The gain of each bucket: how much likelier the target has its features, as a floored thousandth of a logarithm."""
    ours, theirs = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, rows in ((ours, bucket_counts(docs, text, ngrams, buckets)), (theirs, bucket_counts(target, target_text, ngrams, buckets))):
        held = rows.toArrow()  # at most ``buckets`` rows, whatever the data
        counts[held.column("bucket").to_numpy()] = held.column("n").to_numpy()
    share = ((theirs + 1.0) * float(ours.sum() + buckets)) / ((ours + 1.0) * float(theirs.sum() + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str, text: str, ngrams: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of a text's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for batch in by_size(batches, text, SLICE_BYTES):
            size = batch.num_rows
            count, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
            words = np.zeros(size, np.int64)
            for places, owners, held in batch_buckets(batch.column(text), ngrams, len(value)):
                words += held
                count += np.bincount(owners, minlength=size)
                # floats are exact here: a slice's sums stay far below 2 ** 53
                total += np.bincount(owners, value[places], minlength=size).astype(np.int64)
            mean = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *[pa.array(a, pa.int64()) for a in (words, count, mean)]],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    ngrams: int = 2,
    buckets: int = BUCKETS,
    min_words: int = 20,
    percent: int = 25,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` from 1 in falling score for
    the drawn ones, ``percent`` in a hundred of those with ``min_words`` words, null for the rest."""
    gains = bucket_gains(docs, target, text, target_text, ngrams, buckets)
    weighed = weights(docs, gains, id_col, text, ngrams)
    spelled = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), spelled).cast("binary"), 256), 1, 8)
    uniform = (F.conv(first, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = stage(weighed.withColumn("score", F.col("weight") + noise), "resampling-scores")
    able = scored.filter(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    placed = numbered(able, [], order, "_place", "_total")
    drawn = F.col("_place") < F.floor(F.col("_total") * percent / 100)
    ranked = placed.select(*scored.columns, F.when(drawn, F.col("_place") + 1).alias("rank"))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)

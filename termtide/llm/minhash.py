"""Near-duplicate detection by an inverted join on MinHash coordinates.

A document's set of word shingles has a signature of ``COORDINATES`` smallest
hashes. Every two neighbouring coordinates with their values name a posting list of the
documents that have both: one value alone is shared by all documents that have one common
shingle, and lists of such chance meetings grow with the square of the data. Documents similar
enough share at least ``match_threshold`` of these lists but with negligible probability, and
then, in any fixed order of the lists, their first ``lists - match_threshold + 1`` ones (the
prefix) have one in common. Lists are ordered by length, shortest first, so that the long lists
of common shingles are skipped: collisions in them are only counted, on sketches of the
signatures, for pairs that meet in a shorter one.

Documents with equal sets are one representative. Pairs are then met list by list
without listing all pairs of a group: in each round every list has one random leader,
and of the leaders that a representative meets and is not connected with, the one
nearest by sketch and parity is its partner of the round, so a round has at most one pair for each
representative. When rounds find little more, a last step meets the pairs of a list that are still
unconnected: members outside the largest component of the list with all others.

A pair goes to its full shingle sets only if its sizes allow the similarity, its sketches
agree in enough coordinates, and its parities allow it: bit ``i`` of a set's parity says
whether an odd number of its shingles fall in cell ``i``, so two parities differ in no more
bits than shingles are in one set only. That bound is certain and loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtide.llm.bitmaps import mark_among
from termtide.llm.common import by_size, byte_pieces, free_name, released, text_batches
from termtide.llm.components import components
from termtide.llm.ordering import own_ids
from termtide.operators.joins import lookup_join
from termtide.session import stage

COORDINATES = 64
# At exactly the threshold, at most this share of the pairs collides less often.
MISSED = 1e-6
LEADER_ROUNDS = 4
_CELLS = 1 << 22
_BLOCK = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 100_000
# Cells of a parity. Sets of far more shingles than that are told apart by their sketches alone.
PARITY_BITS = 512


def match_threshold(similarity: float, coordinates: int = COORDINATES) -> int:
    """Collisions that a pair of this similarity has but with negligible probability."""
    below, k = 0.0, 0
    while k < coordinates:  # the exact binomial tail
        below += comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > MISSED:
            break
        k += 1
    return max(1, k)


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(11)
    a = random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case, as bytes: both go by ASCII alone."""
    return text.lower().split()


def shingles(text: bytes, size: int) -> set:
    """The distinct shingles; of fewer words than ``size`` the whole sequence is one, of no words none."""
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def shingle_hashes(text: bytes, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > _WORDS_KEPT:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    a, b = _family()
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for low in range(0, len(hashes), 4096):
        part = (hashes[low : low + 4096, None] * a + b) >> np.uint64(32)
        least = np.minimum(least, part.min(axis=0))
    return least.astype(np.uint32)


def parity(hashes: np.ndarray) -> bytes:
    """One bit a cell: whether an odd number of the hashes fall in it."""
    cells = (hashes >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=PARITY_BITS).astype(np.uint8) & 1).tobytes()


_SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary, parity binary"


def sign(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, sig, parity``: size and 128-bit digest of the shingle set, its signature and parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in by_size(batches, "text", 2 << 20):
            data, offsets = byte_pieces(batch.column("text"))
            data = data.tobytes()
            counts, digests, sigs, parities = [], [], [], []
            for i in range(batch.num_rows):
                hashes = shingle_hashes(data[offsets[i] : offsets[i + 1]], size, known)
                counts.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sigs.append(signature(hashes).tobytes() if len(hashes) else b"")
                parities.append(parity(hashes))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])),
                    *(pa.array(sigs, pa.binary()), pa.array(parities, pa.binary())),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "sig", "parity"],
            )

    return docs.mapInArrow(released(run), _SIGNED)


def list_width(similarity: float) -> int:
    """How many coordinates name a list: two, unless pairs of this similarity could then share none."""
    return 2 if (1 - similarity**2) ** (COORDINATES // 2) <= MISSED else 1


def _keys(sigs: list[bytes], width: int) -> np.ndarray:
    """A 64-bit name of every ``width`` coordinates and their values: rows of ``COORDINATES // width``."""
    values = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, COORDINATES // width, width).astype(np.uint64)
    x = np.arange(COORDINATES // width, dtype=np.uint64) << np.uint64(32)
    for i in range(width):
        x = (x + values[:, :, i]) * _MIX
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x


def _cells(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(42)).astype(np.int64)


def _count_cells(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_CELLS, np.int32)
        for batch in batches:
            if batch.num_rows:
                np.add.at(counts, _cells(_keys(batch.column(0).to_pylist(), width)).ravel(), 1)
        counts = np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(-1, _BLOCK)
        for block in np.flatnonzero(counts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([counts[block].tobytes()])], ["block", "counts"])

    return run


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the blocks of a number, which follow each other, and keeps the logarithms."""
    number, total = None, None

    def done() -> Iterator[pa.RecordBatch]:
        if number is not None:
            logs = np.minimum(np.log2(total + 1) * 4, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([logs.tobytes()])], ["block", "logs"])

    for batch in batches:
        for n, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(counts, np.uint16).astype(np.int64)
            if n != number:
                yield from done()
                number, total = n, part
            else:
                total = total + part
    yield from done()


def list_lengths(sigs: DataFrame, width: int) -> np.ndarray:
    """About how long each posting list is, as a logarithm by the cell its name falls in: 4 MB at any size of
    the data. It only serves to order the lists, the same for all documents."""
    blocks = sigs.mapInArrow(released(_count_cells(width)), "block bigint, counts binary").repartition("block").sortWithinPartitions("block")
    logs = np.zeros(_CELLS, np.uint8)
    for row in blocks.mapInArrow(_add_cells, "block bigint, logs binary").collect():
        logs[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.logs, np.uint8)
    return logs


def postings(reps: DataFrame, similarity: float) -> DataFrame:
    """``key, rep, n_shingles``: each representative (``rep, n_shingles, sig``) under the lists of its prefix."""
    width = list_width(similarity)
    n = COORDINATES // width
    prefix = n - match_threshold(similarity**width, n) + 1
    lengths = reps.sparkSession.sparkContext.broadcast(list_lengths(reps.select("sig"), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(batch.column("sig").to_pylist(), width)
                order = np.lexsort((keys, lengths.value[_cells(keys)]))[:, :prefix]
                names = np.take_along_axis(keys, order, axis=1).ravel().view(np.int64)
                own = [pa.array(np.repeat(batch.column(c).to_numpy(), prefix)) for c in ("rep", "n_shingles")]
                yield pa.RecordBatch.from_arrays([pa.array(names), *own], ["key", "rep", "n_shingles"])

    return reps.select("rep", "n_shingles", "sig").mapInArrow(released(run), "key bigint, rep bigint, n_shingles bigint")


_SKETCH = [f"s{i}" for i in range(4)]
_PARITY = [f"p{i}" for i in range(PARITY_BITS // 64)]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last four bits of each coordinate, sixteen in a number, and the parity as numbers."""
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, len(_SKETCH), 16)
            low = values.astype(np.uint64) & np.uint64(15)
            packed = (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
            bits = np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.int64).reshape(-1, len(_PARITY))
            numbers = [pa.array(np.ascontiguousarray(column)) for table in (packed, bits) for column in table.T]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n_shingles"), *numbers], ["rep", "n_shingles", *_SKETCH, *_PARITY])


def sketches(reps: DataFrame) -> DataFrame:
    """``rep, n_shingles``, the sketch and the parity of each representative."""
    numbers = ", ".join(f"{c} bigint" for c in ("rep", "n_shingles", *_SKETCH, *_PARITY))
    return reps.select("rep", "n_shingles", "sig", "parity").mapInArrow(released(_sketched), numbers)


def _sum(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def _apart() -> Column:
    """How many coordinates of two documents differ for certain: in their last four bits."""
    counts = []
    for name in _SKETCH:
        x = F.col(name).bitwiseXOR(F.col(f"{name}_b"))
        for bits in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, bits))
        counts.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return _sum(counts)


def able_sizes(percent: int) -> Column:
    """Whether the sizes ``n_shingles, n_b`` of two sets allow the similarity."""
    return (100 * F.least("n_shingles", "n_b")) >= percent * F.greatest("n_shingles", "n_b")


def _odd() -> Column:
    """In how many bits two parities differ."""
    return _sum([F.bit_count(F.col(name).bitwiseXOR(F.col(f"{name}_b"))) for name in _PARITY])


def close_sketches(percent: int) -> Column:
    """Whether two sets can have the similarity, by sketches (but with negligible probability) and parities (for certain)."""
    similarity = percent / 100
    # other coordinates agree in their last four bits one time in sixteen
    collide = _apart() <= COORDINATES - match_threshold(similarity + (1 - similarity) / 16)
    # shingles in one set only are at most (1 - s) / (1 + s) of both sizes
    return collide & (_odd() * (100 + percent) <= (100 - percent) * (F.col("n_shingles") + F.col("n_b")))


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, set] = (b"", set())
        for batch in by_size(batches, "text_a"):
            good = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                x, y = x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes()
                if y != last[0]:
                    last = (y, shingles(y, size))
                one, two = shingles(x, size), last[1]
                both = len(one & two)
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _with(pairs: DataFrame, table: DataFrame, side: str, values: dict[str, str]) -> DataFrame:
    """``pairs`` with columns of one side's representative, under the names given."""
    other = table.select(F.col("rep").alias(side), *[F.col(old).alias(new) for old, new in values.items()])
    return lookup_join(pairs, other, [side], "inner")


def _b_side(columns: list[str]) -> dict[str, str]:
    return {c: "n_b" if c == "n_shingles" else f"{c}_b" for c in columns}


class _Search:
    def __init__(self, docs: DataFrame, reps: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.texts = docs.select(F.col("doc_id").alias("rep"), "text")
        lists = stage(postings(reps, percent / 100), "postings")
        # lists of one member join nobody
        shared = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        self.lists = stage(lookup_join(lists, shared, ["key"], "inner"), "shared-postings")
        # nobody else is compared
        self.sketches = stage(lookup_join(sketches(reps), self.lists.select("rep").distinct(), ["rep"], "inner"), "sketches")
        self.labels = None  # of representatives that are not the label of their component themselves

    def labelled(self) -> DataFrame:
        if self.labels is None:
            return self.lists.withColumn("label", F.col("rep"))
        known = self.labels.select(F.col("node").alias("rep"), F.col("label").alias("_l"))
        return lookup_join(self.lists, known, ["rep"], "left").withColumn("label", F.coalesce("_l", "rep")).drop("_l")

    def confirmed(self, close: DataFrame) -> DataFrame:
        """Of the staged pairs ``a, b``, those whose sets have the similarity. All texts are read once; only
        those that may be of a pair are written, and shuffled on the side where they may be."""
        texts = mark_among(mark_among(self.texts, "rep", close.select("a"), "of_a"), "rep", close.select("b"), "of_b")
        with text_batches(close.sparkSession):
            texts = stage(texts.filter("of_a or of_b").withColumn("text", F.col("text").cast("binary")), "texts")
        paired = _with(_with(close, texts.filter("of_a"), "a", {"text": "text_a"}), texts.filter("of_b"), "b", {"text": "text_b"})
        return paired.select("a", "b", "text_a", "text_b").mapInArrow(released(_confirmed(self.size, self.percent)), "a bigint, b bigint")

    def add(self, links: DataFrame) -> bool:
        """Takes links in and connects; says whether there were any."""
        with text_batches(links.sparkSession):
            links = stage(links, "links")
        if not links.head(1):
            return False
        if self.labels is None:
            self.labels = stage(components(links).filter("node <> label"), "labels")
            return True
        known = self.labels.select(F.col("node").alias("rep"), "label")
        a = lookup_join(links.withColumnRenamed("a", "rep"), known, ["rep"], "left")
        a = a.select(F.coalesce("label", "rep").alias("a"), F.col("b").alias("rep"))
        both = lookup_join(a, known, ["rep"], "left").select("a", F.coalesce("label", "rep").alias("b"))
        merged = stage(components(both), "merged")
        tops = merged.select(F.col("node").alias("label"), F.col("label").alias("_top"))
        moved = lookup_join(self.labels, tops, ["label"], "left").select("node", F.coalesce("_top", "label").alias("label"))
        fresh = merged.filter("node <> label").join(self.labels, "node", "left_anti")
        self.labels = stage(moved.unionByName(fresh), "labels")
        return True

    def leader_round(self, number: int) -> bool:
        """Each representative and the nearest leader it meets; says whether there were links."""
        lists = self.labelled()
        rank = F.xxhash64(F.lit(number), "key", "rep") if number else F.xxhash64(F.lit(number), "rep")
        member = F.struct(rank.alias("rank"), F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("label").alias("label_b"))
        leaders = lists.groupBy("key").agg(F.min(member).alias("_l")).select("key", "_l.*").drop("rank")
        met = lookup_join(lists, leaders, ["key"], "inner").filter((F.col("label") != F.col("label_b")) & able_sizes(self.percent))
        pairs = met.select(F.col("rep").alias("a"), "b").distinct()
        columns = ["n_shingles", *_SKETCH, *_PARITY]
        both = _with(_with(pairs, self.sketches, "a", {c: c for c in columns}), self.sketches, "b", _b_side(columns))
        close = both.filter(close_sketches(self.percent)).withColumn("odd", _odd())
        nearest = close.groupBy("a").agg(F.min(F.struct("odd", "b")).alias("_n")).select("a", F.col("_n.b").alias("b"))
        return self.add(self.confirmed(stage(nearest, "close-pairs")))

    def all_others(self) -> None:
        """Every pair of a list that is not connected yet."""
        lists = stage(self.labelled(), "labelled-postings")
        counts = lists.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        largest = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("_m"), F.count(F.lit(1)).alias("labels"))
        mixed = largest.filter("labels > 1").select("key", F.col("_m.label").alias("main"))
        rest = lookup_join(lists, mixed, ["key"], "inner").drop("n_shingles")
        open_ = stage(lookup_join(rest, self.sketches, ["rep"], "inner"), "open-postings")
        columns = ["rep", "label", "n_shingles", *_SKETCH, *_PARITY]
        few = open_.filter("label <> main").select(F.col("key").alias("_key"), *[F.col(old).alias(new) for old, new in _b_side(columns).items()])
        # members outside the main component meet all of it, and each other once
        cond = (F.col("label") != F.col("label_b")) & ((F.col("label") == F.col("main")) | (F.col("rep") < F.col("rep_b")))
        met = open_.join(few, (F.col("key") == F.col("_key")) & cond & able_sizes(self.percent) & close_sketches(self.percent))
        pairs = met.select(F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct()
        self.add(self.confirmed(stage(pairs, "close-pairs")))


def near_groups(docs: DataFrame, size: int = 2, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``doc_id, n_shingles, component_id, kept``.

    ``n_shingles`` is the size of its set of ``size``-word shingles (words apart by
    white space, A-Z folded; fewer words than that are one shingle, none an empty
    set). Documents are linked if 100 times the common shingles are at least
    ``percent`` times all of both sets; ``component_id`` is the smallest id that links
    reach, and that document is kept. Empty sets (also null texts) are linked with
    nothing. Rows that share an id are documents of their own: all of a kept id are kept. A row
    without id comes behind all others, so its component has a null id only if no row of it has one.
    Further columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    apart = own_ids(own, "doc_id", "text", nulls_last=True)
    if apart is None:
        return _groups(own, size, percent)
    rows, number = apart
    found = _groups(rows.select(F.col(number).alias("doc_id"), "text"), size, percent)
    ids = rows.select(F.col(number).alias("_number"), F.col("doc_id").alias("_id"))
    named = lookup_join(found.withColumnRenamed("doc_id", "_number"), ids, ["_number"], "inner").select(
        F.col("_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("_number")
    )
    every = lookup_join(named, ids, ["_number"], "inner").select("doc_id", "n_shingles", F.col("_id").alias("component_id"))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _groups(own: DataFrame, size: int, percent: int) -> DataFrame:
    """``near_groups`` of ``doc_id, text`` where each row has an id of its own."""
    with text_batches(own.sparkSession):
        signed = stage(sign(own, size), "signatures")
    filled = signed.filter("n_shingles > 0")
    first = F.min(F.struct("doc_id", "n_shingles", "sig", "parity"))
    columns = [F.col("_f.doc_id").alias("rep"), "_f.n_shingles", "_f.sig", "_f.parity"]
    reps = filled.groupBy("d1", "d2").agg(first.alias("_f")).select("d1", "d2", *columns)
    reps = stage(reps, "representatives")
    search = _Search(own, reps, size, percent)
    for number in range(LEADER_ROUNDS):
        if not search.leader_round(number):
            break
    search.all_others()
    of_rep = reps.select("d1", "d2", F.col("rep").alias("component_id"))
    if search.labels is not None:
        known = search.labels.select(F.col("node").alias("rep"), "label")
        of_rep = lookup_join(reps.select("d1", "d2", "rep"), known, ["rep"], "left").select(
            "d1", "d2", F.coalesce("label", "rep").alias("component_id")
        )
    members = lookup_join(filled.select("doc_id", "n_shingles", "d1", "d2"), of_rep, ["d1", "d2"], "inner")
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = members.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document, that of the smallest id, of each group of near copies, with the columns of ``docs``.

    Documents that are not among those that go, by a bitmap of these, are not shuffled.
    """
    groups = near_groups(docs, size, percent, id_col, text)
    gone = stage(groups.filter("not kept").select(F.col("doc_id").alias(id_col)), "near-copies")
    maybe = free_name(docs, "maybe_gone")
    marked = mark_among(docs, id_col, gone, maybe)
    left = marked.filter(F.col(maybe)).join(gone, id_col, "left_anti")
    return marked.filter(~F.col(maybe)).unionByName(left).select(*[F.col(f"`{c}`") for c in docs.columns])

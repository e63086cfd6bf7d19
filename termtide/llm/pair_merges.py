"""Byte-level byte-pair encoding and decoding, merges picked by a segment tree.

A text is cut at added tokens, then by the splitting pattern into words; a word
begins as its bytes. The leaves of a segment tree hold the rank of each pair of
neighbours and its place, inner nodes the least of their two children, so that
the root names the leftmost pair of the lowest rank. A merge sets three leaves
(the pair's, its right neighbour's, its left neighbour's) and the paths above
them; it ends when the root holds no pair. Each task remembers the ids of words it
has seen, up to a number of bytes.

Defined results: a null text counts as empty and has no ids; an empty table gives none;
repeated and null ids are rows like any other; further columns are left out. The length of
a text is not bounded, its words are taken in slices.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from termtide.llm.common import by_size
from termtide.llm.tokens import vocabulary_path

# Fixed value: the splitting pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY_BYTES = 96 << 20  # of remembered words; beyond it the memory starts anew
_ENTRY_BYTES = 250  # of one remembered word beside its characters and ids
_LONG = 1 << 20  # characters; words of longer texts are taken in slices
_SLICE = 50_000
_NO_PAIR = 1 << 62
_PLACE_BITS = 32
_SIDE_BY_SIDE = 65  # bytes: longer words have a tree of their own
_WORDS_AT_ONCE = 8_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones of Latin-1
    for themselves, the others for the letters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    moved = {b: 256 + i for i, b in enumerate(others)}
    return [chr(moved.get(b, b)) for b in range(256)]


@lru_cache(maxsize=1)
def standins() -> dict[int, str]:
    """Characters that the pattern library puts in another class than the tokenizers library does, as their
    tables are of different years, and for each a character of the right class to look for words with."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    words = regex.compile(SPLIT)
    found = {}
    for c in range(0x110000):
        # later tables differ in what Python's leave open; planes 4 to 13 are not assigned by any
        if unicodedata.category(chr(c)) != "Cn" or 4 <= c >> 16 <= 13:
            continue
        probe = f"a{chr(c)}1{chr(c)}"
        spans = [span for _, span in split.pre_tokenize_str(probe)]
        if spans != [m.span() for m in words.finditer(probe)]:
            found[c] = "x" if (0, 2) in spans else "1" if (1, 4) in spans else "|"
    return found


class PairTree:
    """Neighbouring pairs of a run of symbols, least rank and leftmost place at the root."""

    def __init__(self, ranks: Iterable[int | None]):
        keys = [_NO_PAIR if r is None else r << _PLACE_BITS | i for i, r in enumerate(ranks)]
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        tree = [_NO_PAIR] * size + keys + [_NO_PAIR] * (size - len(keys))
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        self.tree = tree

    def least(self) -> tuple[int, int] | None:
        """Rank and place of the pair to merge next, or None."""
        key = self.tree[1]
        return None if key == _NO_PAIR else (key >> _PLACE_BITS, key & ((1 << _PLACE_BITS) - 1))

    def set(self, place: int, rank: int | None) -> None:
        """Gives the pair at ``place`` another rank; goes up only as far as something changes."""
        tree = self.tree
        node = self.size + place
        key = _NO_PAIR if rank is None else rank << _PLACE_BITS | place
        while tree[node] != key:
            tree[node] = key
            if node == 1:
                return
            other = tree[node ^ 1]
            node >>= 1
            if other < key:
                key = other


class BytePairs:
    """A vocabulary: ids of bytes, ranks of pairs, what each merge makes, added tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocabulary[c] for c in letters]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(merges):
            self.ranks[vocabulary[left], vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        pairs = np.array([(a << _PLACE_BITS) | b for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], np.array(list(self.ranks.values()), np.int64)[order]
        self.added = dict(added)
        self.standins = standins()
        self.texts: dict[int, bytes] = {}
        for token, i in vocabulary.items():
            outside = any(c not in byte_of for c in token)
            self.texts[i] = token.encode() if outside else bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.texts[i] = token.encode()

    @staticmethod
    def read(path: str) -> BytePairs:
        """From the JSON of the tokenizers library; a feature this encoder does not have is an error."""
        with open(vocabulary_path(path), encoding="utf8") as file:
            whole = json.load(file)
        model, split = whole["model"], whole["pre_tokenizer"] or {}
        off = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        wrong = [name for name in off if model.get(name)]
        wrong += ["model"] if model.get("type", "BPE") != "BPE" else []
        wrong += ["normalizer"] if whole["normalizer"] else []
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        wrong += [] if plain else ["pre_tokenizer"]
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        wrong += [t["content"] for t in whole["added_tokens"] if any(t.get(f) for f in flags)]
        if wrong:
            raise ValueError(f"not a plain byte-level vocabulary: {', '.join(wrong)}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return BytePairs(model["vocab"], merges, {t["content"]: t["id"] for t in whole["added_tokens"]})

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.first[b] for b in word]
        count = len(ids)
        if count < 2:
            return ids
        ranks, made = self.ranks, self.made
        tree = PairTree(map(ranks.get, zip(ids, ids[1:], strict=False)))
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        while found := tree.least():
            rank, place = found
            gone = after[place]
            ids[place] = made[rank]
            right = after[place] = after[gone]
            ids[gone] = -1
            if gone < count - 1:
                tree.set(gone, None)
            if right < count:
                before[right] = place
                tree.set(place, ranks.get((ids[place], ids[right])))
            else:
                tree.set(place, None)
            left = before[place]
            if left >= 0:
                tree.set(left, ranks.get((ids[left], ids[place])))
        return [i for i in ids if i >= 0]

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What the leaves of pairs hold: rank and place, or that there is no such pair."""
        pair = (left << _PLACE_BITS) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        if not len(self.pairs):
            return np.full(pair.shape, _NO_PAIR)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at] << _PLACE_BITS | place, _NO_PAIR)

    def merged_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(lengths > _SIDE_BY_SIDE).tolist():
            out[i] = np.array(self.merged(words[i]), "<u4").tobytes()
        sizes = np.array([1 << max(n - 2, 0).bit_length() for n in range(_SIDE_BY_SIDE + 1)])
        short = np.flatnonzero(lengths <= _SIDE_BY_SIDE)
        for size in np.unique(sizes[lengths[short]]).tolist():
            own = short[sizes[lengths[short]] == size]
            for low in range(0, len(own), _WORDS_AT_ONCE):
                part = own[low : low + _WORDS_AT_ONCE].tolist()
                for i, ids in zip(part, self._merged_rows([words[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _merged_rows(self, words: list[bytes], size: int) -> list[bytes]:
        """``merged_words`` of words whose trees have ``size`` leaves: a row of each array for each word."""
        count, width = len(words), size + 1
        lengths = np.array([len(w) for w in words], np.int64)
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((count, width), -1, np.int64)
        ids[inside] = np.array(self.first, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((count, 2 * size), _NO_PAIR, np.int64)
        paired = inside[:, 1:]
        places = np.broadcast_to(np.arange(size), paired.shape)[paired]
        tree[:, size:][paired] = self._keys(ids[:, :-1][paired], ids[:, 1:][paired], places)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.broadcast_to(np.arange(1, width + 1), ids.shape).copy().ravel()
        before = np.broadcast_to(np.arange(-1, width - 1), ids.shape).copy().ravel()
        flat, nodes = ids.ravel(), tree.ravel()
        made = np.array(self.made or [0], np.int64)
        rows = np.flatnonzero(tree[:, 1] != _NO_PAIR)
        while len(rows):
            base, root = rows * width, rows * (2 * size)
            key = nodes[root + 1]
            place = key & ((1 << _PLACE_BITS) - 1)
            new = made[key >> _PLACE_BITS]
            gone = after[base + place]
            right, left = after[base + gone], before[base + place]
            flat[base + place], flat[base + gone] = new, -1
            after[base + place] = right
            follows, leads = right < lengths[rows], left >= 0
            before[base[follows] + right[follows]] = place[follows]
            own = np.full(len(rows), _NO_PAIR)
            own[follows] = self._keys(new[follows], flat[base[follows] + right[follows]], place[follows])
            nodes[root + size + place] = own
            held = gone < size
            nodes[root[held] + size + gone[held]] = _NO_PAIR
            nodes[root[leads] + size + left[leads]] = self._keys(flat[base[leads] + left[leads]], new[leads], left[leads])
            # the paths above the leaves; where there is none, the pair's own again
            paths = [size + place, size + np.where(held, gone, place), size + np.where(leads, left, place)]
            up = size
            while up > 1:
                up //= 2
                paths = [p >> 1 for p in paths]
                for p in paths:
                    children = root + 2 * p
                    nodes[root + p] = np.minimum(nodes[children], nodes[children + 1])
            rows = rows[nodes[root + 1] != _NO_PAIR]
        kept = ids >= 0
        data = ids[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, added tokens as they are written; bytes that are no UTF-8 become replacement characters."""
        parts = [b"".join(map(self.texts.__getitem__, ids[low : low + _LONG].tolist())) for low in range(0, len(ids), _LONG)]
        return b"".join(parts).decode("utf8", "replace")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, with a memory of words."""

    def __init__(self, model: BytePairs, memory: int = MEMORY_BYTES):
        self.model, self.memory = model, memory
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.words = regex.compile(SPLIT)
        longest = sorted(model.added, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.newer = frozenset(map(chr, model.standins))

    def split(self, text: str) -> Iterator[list[str]]:
        """Lists of the words of a text without added tokens."""
        source = text
        if not text.isascii() and not self.newer.isdisjoint(text):
            source = text.translate(self.model.standins)
        if source is text and len(text) <= _LONG:
            yield self.words.findall(text)
            return
        spans = (m.span() for m in self.words.finditer(source))
        while part := [text[a:b] for a, b in islice(spans, _SLICE)]:
            yield part

    def _learn(self, words: set[str]) -> None:
        """Takes up new words; with the memory full it begins anew with all words given."""
        new = words.difference(self.known)
        if new and self.held > self.memory:
            self.known.clear()
            self.held = 0
            new = words
        spelled = list(new)
        data = [w.encode() for w in spelled]
        found = self.model.merged_words(data)
        self.known.update(zip(spelled, found, strict=True))
        self.held += sum(map(len, data)) + sum(map(len, found)) + _ENTRY_BYTES * len(data)

    def _ids(self, words: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))

    def _parts(self, text: str) -> Iterator[list[str] | bytes]:
        """Lists of words, and the ids of added tokens between them."""
        marks = self.added.finditer(text) if self.added else ()
        start = 0
        for mark in chain(marks, (None,)):
            yield from self.split(text[start : mark.start() if mark else len(text)])
            if mark:
                yield np.array([self.model.added[mark.group()]], "<u4").tobytes()
                start = mark.end()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words of long texts are taken in slices, those of all others at once."""
        short = [list(self._parts(t)) if len(t) <= _LONG else None for t in texts]
        self._learn(set().union(*(p for parts in short if parts for p in parts if isinstance(p, list))))
        found = [b"".join(p if isinstance(p, bytes) else self._ids(p) for p in parts) if parts is not None else None for parts in short]
        for i, text in enumerate(texts):
            if found[i] is None:
                out = []
                for part in self._parts(text):
                    if isinstance(part, list):
                        self._learn(set(part))
                        part = self._ids(part)
                    out.append(part)
                found[i] = b"".join(out)
        return found


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, model: BytePairs) -> Encoder:
    """This worker's encoder of that name with the words of its earlier tasks, one at a time."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(model)
    return _ENCODERS[name]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: ids in little-endian unsigned 32 bits, as the tokenizers library gives them
    without special tokens around the text. The vocabulary is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(BytePairs.read(path))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(name, shared.value)
        for batch in by_size(batches, text, 4 << 20):
            ids = coder.encode([t or "" for t in batch.column(text).to_pylist()])
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encode_documents`` and ``decoded``, the text of the ids."""
    shared = coded.sparkSession.sparkContext.broadcast(BytePairs.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_size(batches, "ids", 4 << 20):
            texts = [model.decode(np.frombuffer(ids or b"", "<u4")) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    rows = coded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")

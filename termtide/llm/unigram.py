"""SentencePiece encoding and decoding: a Unigram model over a double-array trie.

The pieces of a model with their log scores lie in a double-array trie of bytes.
Viterbi finds the segmentation of the highest total score; characters that no
piece covers fall back to byte pieces. Pieces hold the marker of a blank only at
their beginning (checked when a model is loaded), so that no piece reaches over a
marker and a text can be cut there: each task segments the distinct words it has
not met yet, all at once and position by position, and remembers the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termtide.llm.common import by_size
from termtide.llm.tokens import vocabulary_path

# Fixed values of the format: the marker of a blank, kinds of pieces, kinds of models.
MARKER = "▁"
_NORMAL, _USER, _UNUSED, _BYTE = 1, 4, 5, 6
_UNIGRAM = 1
UNKNOWN_PENALTY = 10.0  # below the lowest score, for a character without a piece
MEMORY_WORDS = 600_000
_STRETCH = 512


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        length = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + length]
        at += length


@dataclass
class Model:
    """Pieces of a model file: text, log score and kind by id."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    dummy_prefix: bool

    @classmethod
    def read(cls, path: str) -> Model:
        """A model file. A model that is not a Unigram one has merge ranks instead of log scores: its
        pieces get the log probability of their rank by Zipf's law."""
        with open(vocabulary_path(path), "rb") as file:
            data = file.read()
        pieces, scores, kinds = [], [], []
        model_type, prefix = _UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                own = {1: b"", 2: b"\0\0\0\0", 3: _NORMAL, **dict(_fields(value))}
                pieces.append(own[1].decode("utf8"))
                scores.append(np.frombuffer(own[2], "<f4")[0])
                kinds.append(own[3])
            elif number == 2:
                model_type = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
        score = np.array(scores, np.float64)
        if model_type != _UNIGRAM:
            rank = -score
            score = -np.log(rank - rank.min() + 2) - np.log(np.log(len(rank) + 2))
        return cls(pieces, np.round(score, 6), np.array(kinds), prefix)


class DoubleArray:
    """A trie of byte strings: the child of state ``s`` by byte ``b`` is ``base[s] + b + 1`` if its
    ``check`` is ``s``; ``value`` holds the id of the string that ends at a state, or -1."""

    def __init__(self, strings: list[tuple[bytes, int]]):
        strings = sorted(strings)
        size = 1 << 16
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.value = np.full(size, -1, np.int64)
        used = np.zeros(size, bool)
        used[0] = True
        low = wide = 1  # below them no place is free; no place was found for several children
        todo = [(0, 0, len(strings), 0)]
        while todo:
            state, begin, end, depth = todo.pop()
            if begin < end and len(strings[begin][0]) == depth:
                self.value[state] = strings[begin][1]
                begin += 1
            if begin == end:
                continue
            groups = []
            at = begin
            while at < end:
                byte, first = strings[at][0][depth], at
                while at < end and strings[at][0][depth] == byte:
                    at += 1
                groups.append((byte, first, at))
            children = np.array([g[0] for g in groups]) + 1
            start = max(low if len(groups) == 1 else wide, int(children[0]))
            while True:  # the first place where all children find room, looked for in stretches
                while start + _STRETCH + 258 > size:
                    self.base = np.append(self.base, np.zeros(size, np.int64))
                    self.check = np.append(self.check, np.full(size, -1, np.int64))
                    self.value = np.append(self.value, np.full(size, -1, np.int64))
                    used = np.append(used, np.zeros(size, bool))
                    size *= 2
                free = np.flatnonzero(~used[start : start + _STRETCH])[: 1 if len(groups) == 1 else None] + start - children[0]
                fits = free[~used[free[:, None] + children].any(axis=1)] if len(groups) > 1 else free
                if len(fits):
                    base = int(fits[0])
                    break
                start += _STRETCH
            if len(groups) > 1:
                wide = start  # what was too full stays for single children
            self.base[state] = base
            used[base + children] = True
            self.check[base + children] = state
            while used[low]:
                low += 1
            for byte, first, last in groups:
                todo.append((base + byte + 1, first, last, depth + 1))
        self.base, self.check, self.value = (np.append(x, np.full(258, -1, np.int64)) for x in (self.base, self.check, self.value))

    def matches(self, data: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """All strings in ``data`` that begin at any place and end by its ``stop``: for each length, places and ids."""
        place = np.arange(len(data))
        state = np.zeros(len(data), np.int64)
        length = 0
        while True:
            open_ = place + length < stop[place]
            place, state = place[open_], state[open_]
            if not len(place):
                return
            after = self.base[state] + data[place + length] + 1
            good = self.check[after] == state
            place, state = place[good], after[good]
            length += 1
            ends = self.value[state] >= 0
            if ends.any():
                yield length, place[ends], self.value[state[ends]]


class Unigram:
    """Encoder and decoder of one model."""

    def __init__(self, model: Model, memory: int = MEMORY_WORDS):
        self.model = model
        self.memory = memory
        in_trie = [(p.encode(), i) for i, p in enumerate(model.pieces) if model.kinds[i] in (_NORMAL, _USER, _UNUSED) and p]
        for piece, i in in_trie:
            if MARKER.encode() in piece[1:] and piece.decode().strip(MARKER):
                raise ValueError(f"piece {i} has a blank's marker behind its beginning")
        self.trie = DoubleArray(in_trie)
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(model.kinds == _BYTE):
            self.byte_ids[int(model.pieces[i][1:-1], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        self.unknown = float(model.scores.min() - UNKNOWN_PENALTY)
        self.known: dict[str, tuple[bytes, float]] = {}
        self.ids: dict[str, bytes] = {}
        self.score: dict[str, float] = {}
        self._texts = [b"" for _ in model.pieces]
        for i, piece in enumerate(model.pieces):
            if model.kinds[i] in (_NORMAL, _USER, _UNUSED):
                self._texts[i] = piece.replace(MARKER, " ").encode()
            elif model.kinds[i] == _BYTE:
                self._texts[i] = bytes([int(piece[1:-1], 16)])

    def segment(self, words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids and total score of the best segmentation of each string; of equal ones the one whose last
        pieces are longest."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        begins = np.append(0, np.cumsum(sizes))
        stop = np.repeat(begins[1:], sizes)
        within = np.arange(len(data)) - np.repeat(begins[:-1], sizes)
        edges = [(np.full(len(p), n), p, i, self.model.scores[i]) for n, p, i in self.trie.matches(data, stop)]
        # a character without a piece of its own: an edge at a low score
        lead = (data & 0xC0) != 0x80
        width = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        covered = np.zeros(len(data), bool)
        for n, p, _, _ in edges:
            covered[p[width[p] == n[0]]] = True
        bare = np.flatnonzero(lead & ~covered)
        edges.append((width[bare], bare, np.full(len(bare), -1), np.full(len(bare), self.unknown)))
        length, place, piece, gain = (np.concatenate(x) for x in zip(*edges, strict=True))
        order = np.lexsort((length, within[place]))
        length, place, piece, gain = (x[order] for x in (length, place, piece, gain))
        # best[e]: the best score of the word's bytes before e; word ends lie apart from the next begin
        shift = np.repeat(np.arange(len(words)), sizes)  # one place more for each word
        place = place + shift[place] if len(place) else place
        best = np.full(len(data) + len(words), -np.inf)
        best[begins[:-1] + np.arange(len(words))] = 0.0
        back = np.full(len(best), -1)
        steps = np.flatnonzero(np.diff(np.append(-1, within_of(place, begins)))) if len(place) else np.zeros(0, int)
        bounds = np.append(steps, len(place))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            # edges from one place within their words: grouped by length, ends differ
            lens = length[a:b]
            cuts = np.append(np.flatnonzero(np.diff(np.append(-1, lens))), b - a) + a
            for c, d in zip(cuts[:-1], cuts[1:], strict=True):
                end = place[c:d] + length[c:d]
                total = best[place[c:d]] + gain[c:d]
                better = total > best[end]
                best[end[better]] = total[better]
                back[end[better]] = np.arange(c, d)[better]
        return self._trace(words, begins, best, back, length, place, piece)

    def _trace(self, words, begins, best, back, length, place, piece):
        ends = begins[1:] + np.arange(len(words))
        scores = best[ends]
        rows = np.arange(len(words))
        at = ends.copy()
        first = begins[:-1] + np.arange(len(words))
        path_row, path_edge = [], []
        live = at > first
        while live.any():
            rows, at, first = rows[live], at[live], first[live]
            edge = back[at]
            path_row.append(rows)
            path_edge.append(edge)
            at = place[edge]
            live = at > first
        if not path_row:
            return [np.zeros(0, np.int64)] * len(words), scores
        row = np.concatenate(path_row[::-1])
        edge = np.concatenate(path_edge[::-1])
        # steps were taken from the end: the last taken comes first
        step = np.concatenate([np.full(len(r), -k) for k, r in enumerate(path_row)][::-1])
        order = np.lexsort((step, row))
        row, edge = row[order], edge[order]
        ids, out_row = piece[edge], row
        if (ids < 0).any():  # byte fallback
            n = np.where(ids < 0, length[edge], 1)
            source = np.repeat(np.arange(len(edge)), n)
            inner = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
            ids, out_row = ids[source], row[source]
            low = ids < 0
            spread = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8)
            ids = ids.copy()
            ids[low] = self.byte_ids[spread[place[edge[source]] + inner][low]]
        cut = np.searchsorted(out_row, np.arange(len(words) + 1))
        return [ids[cut[i] : cut[i + 1]] for i in range(len(words))], scores

    def words(self, text: str) -> list[str]:
        """The text with markers for blanks, cut before each run of them."""
        marked = (MARKER if self.model.dummy_prefix and text else "") + text.replace(" ", MARKER)
        if MARKER * 2 in marked:
            return re.findall(f"{MARKER}*[^{MARKER}]+|{MARKER}+", marked)
        first, *rest = marked.split(MARKER)
        return ([first] if first else []) + [MARKER + r for r in rest]

    def encode(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """Ids (little-endian 32-bit) and score of each text."""
        cut = [self.words(t) for t in texts]
        own = set().union(*cut)
        new = list(own.difference(self.ids))
        if len(self.ids) + len(new) > self.memory:
            self.ids, self.score = {}, {}
            new = list(own)
        for low in range(0, len(new), 20_000):
            part = new[low : low + 20_000]
            found, scores = self.segment([w.encode() for w in part])
            self.ids.update(zip(part, (f.astype("<u4").tobytes() for f in found), strict=True))
            self.score.update(zip(part, scores.tolist(), strict=True))
        return [(b"".join(map(self.ids.__getitem__, c)), sum(map(self.score.__getitem__, c))) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: markers become blanks, the one put before the text goes, bytes are joined;
        bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self._texts.__getitem__, ids.tolist())).decode("utf8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def within_of(place: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places within their words, for places that have one more for each word before."""
    starts = begins[:-1] + np.arange(len(begins) - 1)
    return place - starts[np.searchsorted(starts, place, side="right") - 1]


_REMEMBERED: dict[tuple, Unigram] = {}


def remembered(name: tuple, model: Unigram) -> Unigram:
    """This worker's encoder of that name, with what it remembers of earlier tasks; at first ``model``."""
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = model
    return _REMEMBERED[name]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, score, decoded``: ids in little-endian 32 bits, the total log score, and the
    text decoded from the ids. A null text counts as empty and has no ids. A marker written in a text
    comes back as a blank. The trie is built once and broadcast: its size is the vocabulary's.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(Unigram(Model.read(path)))
    name = (path, context.applicationId, shared._jbroadcast.id() if shared._jbroadcast else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = remembered(name, shared.value)
        for batch in by_size(batches, text):
            found = model.encode([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).cast(pa.int64()),
                    pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                    pa.array([ids for ids, _ in found], pa.binary()),
                    pa.array([score for _, score in found], pa.float64()),
                    pa.array([model.decode(np.frombuffer(ids, "<u4")) for ids, _ in found], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "score", "decoded"],
            )

    return docs.select(id_col, text).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, score double, decoded string")

"""Token ids of whole texts, with the ``tokenizers`` library.

Most words of a corpus repeat, and a text can be cut at places over which no
token reaches. Each task therefore keeps the ids of the pieces it has seen and
gives the library only new ones, many at once. The cuts are right for tokenizers
whose splitting pattern lets nothing reach over them; see ``cut_points``.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from termtide.llm.common import by_size, give_back, remembered

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side

# Pieces remembered; each takes some 150 bytes. Beyond it the memory starts anew.
MEMORY_PIECES = 600_000
# New pieces given to the library in one text, whose tokens take some hundred bytes each.
LEARNED_AT_ONCE = 20_000
_END = np.zeros(1, "<u4").tobytes()  # id 0 ends a document

# Before the last blank of a run of white space, if a word follows: byte-level patterns let
# a word take one blank before it, and white space before that is a token of its own.
_LEADING_BLANK = re.compile(r"(?= \S)")
# White space other than blanks and line feeds; marks of our own.
_ODD_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# A stop or comma that is not right behind a letter or digit. U+0130 is left out: its lower case ends
# in a combining dot, which patterns take together with the stop.
_RUN = re.compile(r"[.,](?<![a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u02af0-9][.,])")
# ASCII as letters and digits (a), stops and commas (.) and the rest (a blank).
_KINDS = bytes(97 if chr(c).isalnum() else 46 if c in b".," else 32 for c in range(128)) + b" " * 128
# The characters that byte-level vocabularies write for bytes that are not printable ones of Latin-1.
_ALPHABET = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
# Letters before it are letters to every version of Unicode that a library may know.
_LETTERS_END = "\u0250"
_CONTROL = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
# A piece stands for itself with a blank before it, but for these: a stop or comma behind a
# word, a line feed instead of the blank, and a text that is taken as it is.
_STOP, _COMMA, _LINE, _PLAIN = "\x01.", "\x01,", "\x02", "\x04"


def _odd_blanks(text: str) -> bool:
    """Whether white space other than blanks and line feeds is in the text; one look for each character is faster than a class."""
    return any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text) is not None


def _loose_stops(text: str) -> bool:
    """Whether a stop or comma is not right behind a letter or digit."""
    if not text.isascii():
        return _RUN.search(text) is not None
    kinds = text.encode().translate(_KINDS)
    return b" ." in kinds or b".." in kinds or kinds[:1] == b"."


def blank_led(text: str) -> list[str]:
    """Pieces cut at the blank before each word; stops, commas and line feeds apart."""
    if "\x01" in text or "\x02" in text or "\x04" in text:
        return [_PLAIN + text]
    runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    if runs or text != text.strip() or _odd_blanks(text):
        first, *rest = _LEADING_BLANK.split(text)
        return [_PLAIN + first, *[r[1:] for r in rest]]
    if not _loose_stops(text):
        text = text.replace(".\n", f" {_STOP}\n").replace(". ", f" {_STOP} ").replace(", ", f" {_COMMA} ")
    pieces = text.replace("\n", f" {_LINE}").split(" ")
    pieces[0] = _PLAIN + pieces[0]
    return pieces


def written(piece: str) -> str:
    """The text that a piece of ``blank_led`` stands for."""
    if piece[:1] == _PLAIN:
        return piece[1:]
    if piece[:1] == _LINE:
        return "\n" + piece[1:]
    return piece[1:] if piece in (_STOP, _COMMA) else " " + piece


def space_split(text: str) -> list[str]:
    """Words, stops and commas; for tokenizers that drop white space and case."""
    if text.isascii():
        text = text.lower()
    if not _loose_stops(text):
        text = text.replace(". ", " . ").replace(".\n", " . ").replace(", ", " , ")
    return _SPACE.split(text) if _CONTROL.search(text) else text.split()


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of texts as little-endian 32-bit bytes, by way of remembered pieces."""

    def __init__(self, path: str, cut: Callable[[str], list[str]], memory: int = MEMORY_PIECES):
        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.cut = cut
        self.memory = memory
        self.known: dict[str, bytes] = {}
        self.mark, self.mark_ids = "\x01", self._plain("\x01")

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces; words in one long text with a mark of one known id between them."""
        joined = []
        for piece in pieces:
            if self.cut is space_split and len(self.mark_ids) == 1 and self.mark not in piece:
                joined.append(piece)
            else:
                self.known[piece] = np.array(self._plain(piece), "<u4").tobytes()
        for low in range(0, len(joined), LEARNED_AT_ONCE):
            part = joined[low : low + LEARNED_AT_ONCE]
            ids = np.array(self._plain(f" {self.mark} ".join(part)), "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_ids[0]), len(ids))
            if len(ends) != len(part):  # a piece whose ids hold the mark's after all
                for piece in part:
                    self.known[piece] = np.array(self._plain(piece), "<u4").tobytes()
                continue
            start = 0
            for piece, end in zip(part, ends.tolist(), strict=True):
                self.known[piece] = ids[start:end].tobytes()
                start = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        cut = [self.cut(t) for t in texts]
        own = set().union(*cut)
        new = own.difference(known)
        if len(known) + len(new) > self.memory:
            known.clear()
            new = own
        if new:
            self._learn(list(new))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]


class ByteLevelEncoder(PieceEncoder):
    """For byte-level vocabularies: a run of pieces is encoded as one text and cut by the tokens' bytes.

    Words of Latin letters alone are one pre-token of the byte-level pattern, blank included. The library's
    model gets them as they are, without pre-tokenizing and aligning a text first.
    """

    def __init__(self, path: str, memory: int = MEMORY_PIECES):
        super().__init__(path, blank_led, memory)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # one character for each byte
        self.four = [i.to_bytes(4, "little") for i in range(len(self.width))]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = self.tokenizer.normalizer is None and "use_regex=True" in repr(self.tokenizer.pre_tokenizer)
        self.letters = plain and not any(a.strip().isalpha() for a in added)

    def _learn(self, pieces: list[str]) -> None:
        words, lines = [], []
        four, model = self.four, self.tokenizer.model.tokenize
        for piece in pieces:
            if self.letters and piece.isalpha() and (piece.isascii() or max(piece) < _LETTERS_END):
                # the blank, and the bytes of letters beyond ASCII, in the byte alphabet
                word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_ALPHABET)
                self.known[piece] = b"".join([four[t.id] for t in model("\u0120" + word)])
                continue
            # each is a blank or a line feed and a word: what the next one needs to be apart
            start = piece[1:2] if piece[:1] == _LINE else piece[:1]
            if start > " " and not start.isspace() and "<" not in piece:
                (lines if piece[:1] == _LINE else words).append(piece)
            else:
                self.known[piece] = np.array(self._plain(written(piece)), "<u4").tobytes()
        self._learn_runs(words, " ", words)
        self._learn_runs(lines, "\n", [p[1:] for p in lines])

    def _learn_runs(self, pieces: list[str], lead: str, words: list[str]) -> None:
        """Encodes pieces, each written as ``lead`` and its word, many in one text."""
        for low in range(0, len(pieces), LEARNED_AT_ONCE):
            part, own = pieces[low : low + LEARNED_AT_ONCE], words[low : low + LEARNED_AT_ONCE]
            text = lead + lead.join(own)
            ids = np.array(self._plain(text), "<u4")
            sizes = map(len, own) if text.isascii() else (len(w.encode()) for w in own)
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(own)) + 1)
            reach = np.cumsum(self.width[ids])
            at = np.searchsorted(reach, ends)
            if not len(ids) or not np.array_equal(reach[np.minimum(at, len(ids) - 1)], ends):
                for piece, word in zip(part, own, strict=True):
                    self.known[piece] = np.array(self._plain(lead + word), "<u4").tobytes()
                continue
            data, stops = ids.tobytes(), ((at + 1) * 4).tolist()
            self.known.update(zip(part, [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))


def _make(path: str) -> PieceEncoder:
    byte_level = "ByteLevel(" in repr(Tokenizer.from_file(vocabulary_path(path)).pre_tokenizer)[:12]
    return ByteLevelEncoder(path) if byte_level else PieceEncoder(path, space_split)


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary, with what it has learned in earlier tasks."""
    return remembered(("tokens", path), lambda: _make(path))


def encoded(batch: pa.RecordBatch, text: str, path: str) -> list[bytes]:
    """The ids of each text of a batch with the end id; a null text counts as empty."""
    texts = [t or "" for t in batch.column(text).to_pylist()]
    return [ids + _END for ids in encoder(path).encode(texts)]


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut to what is encoded at once, of which all words are held. What an earlier task took is handed back first."""
    give_back()
    yield from by_size(batches, text, 1 << 20)

"""Texts as rows of piece ids of one length, for models that read ids.

The vocabulary is given, as a table of pieces and ids; it is never learned here. A text is
cleaned, lowered, stripped of accents and cut at blanks and punctuation; each word is
cut into the longest pieces of the vocabulary from the left, pieces behind the first written with
``##``. A word without such a cut is one unknown piece. Nothing is shuffled: the vocabulary is broadcast
behind a check of its size, and each task remembers the ids of words it has seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.functions.text import strip
from termtide.session import ship_package
from termtide.sources.lines import numbered, text_lines

# The vocabulary is a parameter of a model; a table beyond this is taken for something else.
MAX_PIECES = 1 << 20
MAX_LENGTH = 512
MAX_WORD = 100  # characters; longer words are unknown
CONTINUED = "##"
PAD, UNKNOWN, BEGIN, END = "[PAD]", "[UNK]", "[CLS]", "[SEP]"

_MEMORY_BYTES = 64 << 20
_ENTRY_BYTES = 300
_BLANKS = re.compile(
    "[" + "".join(re.escape(chr(c)) for c in range(0x3001) if chr(c) in "\t\n\r" or unicodedata.category(chr(c))[0] == "Z") + "]+"
)
# Ranges of ideographs, each a word of its own: fixed values of the public rule.
_IDEOGRAPHS = [
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
]
_APART = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _IDEOGRAPHS) + "])")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``piece, id``: one piece a line, its id the number of the line from 0."""
    lines = numbered(text_lines(spark, path), "id")
    return lines.select(strip(F.col("value")).alias("piece"), F.col("id").cast("int").alias("id"))


def _is_mark(char: str) -> bool:
    """Punctuation, and the signs of ASCII that are neither letters, digits nor blanks."""
    if char.isascii():
        return char > " " and not char.isalnum()
    return unicodedata.category(char)[0] == "P"


def plain_words(text: str) -> Iterator[str]:
    """The words and marks of a text without blanks, cleaned, in lower case and without accents."""
    kept = (c for c in text if c not in "\0�" and unicodedata.category(c)[0] != "C")
    spaced = _APART.sub(r" \1 ", "".join(kept))
    bare = (c for c in unicodedata.normalize("NFD", spaced) if unicodedata.category(c) != "Mn")
    word = ""
    for char in "".join(bare).lower():
        if char == " " or _is_mark(char):
            if word:
                yield word
            word = ""
            if char != " ":
                yield char
        else:
            word += char
    if word:
        yield word


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and their ids; the four special pieces are to be among them."""

    ids: dict[str, int]

    @staticmethod
    def of(table: DataFrame) -> Vocabulary:
        """Of a table ``piece, id``. The first id of a repeated piece counts."""
        first = table.groupBy("piece").agg(F.min("id").alias("id"))
        rows = first.limit(MAX_PIECES + 1).toArrow()
        if rows.num_rows > MAX_PIECES:
            raise ValueError(f"a vocabulary of more than {MAX_PIECES} pieces")
        ids = dict(zip(rows["piece"].to_pylist(), rows["id"].to_pylist(), strict=True))
        missing = [p for p in (PAD, UNKNOWN, BEGIN, END) if p not in ids]
        if missing:
            raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
        return Vocabulary(ids)

    @property
    def size(self) -> int:
        return max(self.ids.values()) + 1

    def pieces(self, word: str) -> list[int]:
        """The longest pieces from the left, or the unknown one."""
        found, start = [], 0
        if len(word) > MAX_WORD:
            return [self.ids[UNKNOWN]]
        while start < len(word):
            lead = CONTINUED if start else ""
            for end in range(len(word), start, -1):
                piece = self.ids.get(lead + word[start:end])
                if piece is not None:
                    break
            else:
                return [self.ids[UNKNOWN]]
            found.append(piece)
            start = end
        return found

    def encode(self, text: str, max_length: int, known: dict[str, list[int]]) -> list[int]:
        """Ids with the begin and end pieces, no more than ``max_length``; ``known`` holds those of runs without blanks."""
        out, room = [self.ids[BEGIN]], max_length - 2
        start = 0
        while start <= len(text) and room > 0:
            gap = _BLANKS.search(text, start)
            run = text[start : gap.start() if gap else len(text)]
            start = gap.end() if gap else len(text) + 1
            ids = known.get(run)
            if ids is None:
                ids = [i for word in plain_words(run) for i in self.pieces(word)]
                known[run] = ids
            out += ids[:room]
            room -= len(ids)
        return [*out, self.ids[END]]


def encode_pieces(
    entries: DataFrame, vocabulary: Vocabulary, max_length: int = MAX_LENGTH, text: str = "text"
) -> DataFrame:
    """Entries with ``input_ids`` and ``attention_mask``, both of ``max_length``.

    Longer texts are cut, shorter ones filled up with the padding piece, whose mask is 0. A null
    text counts as empty. Columns of these names are replaced.
    """
    if max_length < 2:
        raise ValueError("max_length leaves no room for the begin and end pieces")
    ship_package(entries.sparkSession)
    shared = entries.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        held, seen = 0, 0
        for texts in batches:
            out = []
            for t in texts.fillna(""):
                out.append(shared.value.encode(t, max_length, known))
                if len(known) > seen:
                    held += (len(known) - seen) * _ENTRY_BYTES + len(t)
                    if held > _MEMORY_BYTES:
                        known.clear()
                        held = 0
                    seen = len(known)
            yield pd.Series(out, dtype=object)

    rest = F.lit(max_length) - F.size("input_ids")
    padded = F.concat("input_ids", F.array_repeat(F.lit(vocabulary.ids[PAD]), rest))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), rest))
    return entries.withColumn("input_ids", ids_of(F.col(text))).withColumns({"attention_mask": mask, "input_ids": padded})


def used_ids(ids: str = "input_ids", mask: str = "attention_mask") -> Column:
    """The ids that are not padding."""
    return F.slice(ids, F.lit(1), F.aggregate(mask, F.lit(0), lambda n, m: n + m))

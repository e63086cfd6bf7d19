"""Toxicity by a weighted lexicon.

Texts are folded: compatibility forms, look-alike letters of other alphabets and,
in words that hold a letter, digits and signs that stand for letters become plain
lower-case letters; words with accents, digits or signs are matched with and without
folding them, and what stands between words is one blank. One Aho-Corasick automaton then finds all
terms of the lexicon (whole words and beginnings of words, with weights) and the
exception phrases that take a term's weight back. The sum, over the logarithm of
the number of words, goes through a logistic curve.

Terms, exceptions and curve are learned from labelled rows: a term is a word or
beginning of words that toxic texts have far more often than others, by a
likelihood ratio that grows with the number of candidates tested.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termtide.llm.common import by_size, filled, released
from termtide.session import stage

# The bounded sample of labelled rows that a lexicon is learned from, in hash order.
SAMPLE_ROWS = 20_000
STEM_LENGTHS = (4, 8)
MIN_DOCS = 5
MIN_TOXIC_SHARE = 0.5
EXCEPTION_DOCS = 3
EXCEPTION_SHARE = 0.1
# How far above chance, in units of the likelihood ratio, beyond the number of tests.
MARGIN = 10.0

# Look-alikes of Latin letters in other alphabets.
_HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
        "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "һ": "h", "ɡ": "g", "ո": "n", "ս": "u",
        "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
        "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    }
)
# Digits and signs written for letters.
_DIGITS = str.maketrans("013457@$", "oieastas")
# From the first of them in a word to the word's end.
_DIGIT_REST = re.compile(r"[013457@$](?:[^\W_]|[@$])*")
_LETTER = re.compile(r"[^\W\d_]")
_MARKS = re.compile("[\u0300-\u036f]+")
_BETWEEN = re.compile(r"[\W_]+")


def _letters_for_digits(text: str) -> tuple[str, list[str]]:
    """The text with digits and signs as letters in words that hold a letter, and these words as they were."""
    parts: list[str] = []
    disguised: list[str] = []
    done = 0
    for found in _DIGIT_REST.finditer(text):
        start = found.start()
        while start > done and text[start - 1].isalnum():
            start -= 1
        word = text[start : found.end()]
        if _LETTER.search(word):
            parts += [text[done:start], word.translate(_DIGITS)]
            disguised.append(word)
            done = found.end()
    return "".join(parts) + text[done:], disguised


def fold(text: str) -> str:
    """Folded words with one blank before, between and after them; words with digits or signs for letters stand
    once more, as they were, at the end, and words with accents without them, so that a term can be told by its
    digits or accents or in spite of them."""
    plain = text.isascii()
    text = text.lower() if plain else unicodedata.normalize("NFKC", text).lower().translate(_HOMOGLYPHS)
    text, disguised = _letters_for_digits(text)
    words = _BETWEEN.sub(" ", " ".join([text, *disguised])).strip()
    if plain:
        return f" {words} "
    bare = [_bare(w) for w in words.split(" ") if not w.isascii()]
    return f" {words} {' '.join(bare)} " if bare else f" {words} "


def _bare(word: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", word))


@dataclass
class Lexicon:
    """Terms are written as they are matched: ``" word "`` or ``" beginning"``."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -1.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in {**self.terms, **self.exceptions}.items():
            found.add_word(term, weight)
        if len(found):
            found.make_automaton()
            return found
        return None


def density(folded: str, automaton: ahocorasick.Automaton | None) -> float:
    """The weight found in a folded text, over the logarithm of its length in words."""
    if automaton is None or len(folded) < 3:
        return 0.0
    total = sum(weight for _, weight in automaton.iter(folded))
    return max(0.0, total) / math.log2(1 + folded.count(" "))


def in_sample(labels: DataFrame) -> DataFrame:
    """At most ``SAMPLE_ROWS`` labelled rows ``doc_id, toxic``, in the order of a hash of the id."""
    known = labels.filter("toxic is not null and doc_id is not null")
    one = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)


def _folded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text"):
        texts = [fold(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts), batch.column("toxic")], ["folded", "toxic"])


def _gain(t: float, n: float, all_t: float, all_n: float) -> float:
    """Likelihood ratio of a feature in ``t`` of the toxic and ``n`` of the other texts."""

    def part(x: float, size: float, share: float) -> float:
        own = min(max(x / size, 1e-9), 1 - 1e-9)
        return x * math.log(own / share) + (size - x) * math.log((1 - own) / (1 - share))

    share = min(max((t + n) / (all_t + all_n), 1e-9), 1 - 1e-9)
    return 2 * (part(min(t, all_t), all_t, share) + part(min(n, all_n), all_n, share))


def _candidates(sample: DataFrame) -> DataFrame:
    """``term, t, n``: texts, toxic and other, with each whole word and each beginning of words."""
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.trim("folded"), " "))).alias("word"))
    counts = words.filter("word <> ''").groupBy("word").agg(
        F.sum(F.expr("int(toxic = 1)")).alias("t"), F.sum(F.expr("int(toxic <> 1)")).alias("n")
    )
    low, high = STEM_LENGTHS
    stems = F.transform(F.sequence(F.lit(low), F.least(F.length("word"), F.lit(high))), lambda i: F.left("word", i))
    whole = F.array(F.concat("word", F.lit(" ")))
    both = F.when(F.length("word") >= low, F.concat(stems, whole)).otherwise(whole)
    spread = counts.select(F.explode(both).alias("term"), "t", "n")
    return spread.groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def _needed(tested: int) -> float:
    """The gain that a term has to have."""
    return 2 * math.log(max(tested, 1)) + MARGIN


def _strong(all_t: int, all_n: int, tested: int):
    """Of candidates ``term, t, n``, those with the gain needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("t").to_pylist(), batch.column("n").to_pylist(), strict=True)
            yield batch.filter(pa.array([_gain(t, n, all_t, all_n) >= _needed(tested) for t, n in pairs], pa.bool_()))

    return run


def _chosen(rows: list, all_t: int, all_n: int, tested: int) -> dict[str, float]:
    """Weights of the terms that pass; of terms that begin with one another only the strongest, the longest of equal ones."""
    needed = _needed(tested)
    gains = [(_gain(r.t, r.n, all_t, all_n), r.term, r.t, r.n) for r in rows]
    terms: dict[str, float] = {}
    stems: set[str] = set()
    for gain, term, t, n in sorted(gains, key=lambda x: (-round(x[0], 6), -len(x[1]), x[1])):
        if gain < needed:
            break
        starts = {term[:i] for i in range(1, len(term) + 1)}
        if starts & terms.keys() or term in stems:
            continue
        terms[term] = math.log((t + 0.5) / (all_t + 1)) - math.log((n + 0.5) / (all_n + 1))
        stems |= starts
    return {" " + term: round(weight, 6) for term, weight in terms.items()}


def _phrases(terms: dict[str, float]):
    """Two-word phrases around each term found, once a text: ``phrase, weight, toxic``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(terms).automaton()
        for batch in by_size(batches, "folded"):
            out: list[tuple[str, float, int]] = []
            for text, toxic in zip(batch.column("folded").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen = {}
                for end, weight in automaton.iter(text) if len(text) > 2 else ():
                    # back to the blank before the word that the match begins, on to the one after it
                    left = text.rfind(" ", 0, end)
                    right = text.find(" ", max(end, left + 1))
                    before = text.rfind(" ", 0, left) if left > 0 else -1
                    after = text.find(" ", right + 1)
                    if before >= 0:
                        seen[text[before : right + 1]] = weight
                    if after >= 0:
                        seen[text[left : after + 1]] = weight
                out += [(phrase, weight, toxic) for phrase, weight in seen.items()]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int32())],
                ["phrase", "weight", "toxic"],
            )

    return run


def _curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.01) -> tuple[float, float]:
    """Logistic regression of one feature, by Newton's method with a small ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from labelled rows (``doc_id, toxic``) and their texts (``doc_id, text``).

    At most ``SAMPLE_ROWS`` labels are used. Without rows of both classes the
    lexicon is empty and every score is 0 but for the curve's default.
    """
    chosen = in_sample(labels)
    # at most SAMPLE_ROWS rows of two numbers
    texts = docs.select("doc_id", filled("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = stage(rows.mapInArrow(released(_folded_rows), "folded string, toxic int"), "toxic-sample")
    total = {r.toxic == 1: r["count"] for r in sample.groupBy(F.expr("int(toxic = 1)").alias("toxic")).count().collect()}
    all_t, all_n = total.get(True, 0), total.get(False, 0)
    if not all_t or not all_n:
        return Lexicon()
    counted = stage(_candidates(sample), "toxic-candidates")
    able = counted.filter((F.col("t") >= MIN_DOCS) & (F.col("t") / (F.col("t") + F.col("n")) >= MIN_TOXIC_SHARE))
    # the threshold and the bounded sample bound what is collected
    tested = counted.count()
    rows = able.mapInArrow(_strong(all_t, all_n, tested), able.schema).collect()
    terms = _chosen(rows, all_t, all_n, tested)
    if not terms:
        return Lexicon()
    phrases = sample.mapInArrow(released(_phrases(terms)), "phrase string, weight double, toxic int")
    mild = phrases.groupBy("phrase", "weight").agg(
        F.sum(F.expr("int(toxic = 1)")).alias("t"), F.sum(F.expr("int(toxic <> 1)")).alias("n")
    )
    mild = mild.filter((F.col("n") >= EXCEPTION_DOCS) & (F.col("t") <= EXCEPTION_SHARE * (F.col("t") + F.col("n"))))
    exceptions = {r.phrase: -r.weight for r in mild.orderBy(F.desc("n"), "phrase", "weight").collect()}
    lexicon = Lexicon(terms, exceptions)

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in by_size(batches, "folded"):
            found = [density(t, automaton) for t in batch.column("folded").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("toxic")], ["x", "toxic"])

    points = sample.mapInArrow(densities, "x double, toxic int").toPandas()  # at most SAMPLE_ROWS
    lexicon.slope, lexicon.offset = _curve(points.x.to_numpy(), (points.toxic == 1).to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, column: str = "toxicity", text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``column``.

    A null text counts as empty, and an empty one gets the score of a text in which
    nothing is found. All columns stay; one called ``column`` is replaced.
    """
    rest = docs.drop(column)
    schema = T.StructType([*rest.schema.fields, T.StructField(column, T.DoubleType())])
    place = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in by_size(batches, text):
            x = np.array([density(fold(t or ""), automaton) for t in batch.column(place).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.offset, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, column])

    return rest.mapInArrow(released(run), schema)

"""Expressions over label lists and class scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_array(labels: Iterable[str]) -> Column:
    """A literal list of labels; they come from the run configuration."""
    items = [F.lit(label) for label in labels]
    return F.array(*items) if items else F.array().cast("array<string>")


def strip_wildcard(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"\*$", "")


def label_subset(labels: Column, use_labels: Iterable[str] | None) -> Column:
    """Only the chosen labels of a list, in the list's order; no choice keeps all."""
    chosen = sorted(use_labels or ())
    if not chosen:
        return labels
    return F.filter(labels, lambda label: F.array_contains(label_array(chosen), label))


def first_label(labels: Column) -> Column:
    """The first label of a list, null when there is none."""
    return F.try_element_at(labels, F.lit(1))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, not once per mention."""
    return F.transform(F.array(value), use)[0]


def softmax(scores: Column) -> Column:
    """Class scores as probabilities; the largest score is taken off first."""

    def scaled(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
        return _let(total, lambda t: F.transform(weights, lambda w: w / t))

    def weighed(s: Column) -> Column:
        return _let(F.array_max(s), lambda top: F.transform(s, lambda v: F.exp(v - top)))

    return _let(scores, lambda s: _let(weighed(s), scaled))


def best_label(scores: Column, labels: Column) -> Column:
    """The label of the largest value; on equal values the first one."""

    def pick(s: Column) -> Column:
        return F.element_at(labels, F.array_position(s, F.array_max(s)).cast("int"))

    return _let(scores, pick)


def best_probability(scores: Column) -> Column:
    """The probability of the largest score."""

    def top(s: Column) -> Column:
        def total(best: Column) -> Column:
            return F.aggregate(s, F.lit(0.0), lambda acc, v: acc + F.exp(v - best))

        return 1 / _let(F.array_max(s), total)

    return _let(scores, top)


def answer_labels(answer: Column, labels: Iterable[str], whole_word: bool = False) -> Column:
    """Labels found in an answer, by first position, equal positions in label order."""
    folded = list(dict.fromkeys(label.lower() for label in labels))
    text = F.lower(answer)

    def place(label: str) -> Column:
        if not whole_word:
            return F.locate(label, text)
        pattern = r"(?U)(?<![\p{L}\p{N}])\Q" + label + r"\E(?![\p{L}\p{N}])"
        return F.regexp_instr(text, F.lit(pattern))

    hits = F.array(
        *[
            F.struct(place(label).alias("at"), F.lit(i).alias("i"), F.lit(label).alias("label"))
            for i, label in enumerate(folded)
        ]
    )
    found = F.array_sort(F.filter(hits, lambda hit: hit["at"] > 0))
    return F.transform(found, lambda hit: hit["label"])

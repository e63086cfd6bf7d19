"""Classifiers an experiment can be run with: what trains on labelled entries and labels others.

A classifier keeps its model below a folder. ``fit`` may be called again on a folder in which an
earlier call stopped, and goes on there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.operators.classify import BatchModel, NaiveBayes, apply_function, apply_naive_bayes, train_naive_bayes
from termtide.operators.encoding import MAX_LENGTH, Vocabulary, encode_pieces
from termtide.operators.softmax import Training, apply_softmax, load_softmax, train_softmax
from termtide.session import stage


class Classifier(Protocol):
    def describe(self) -> dict:
        """Name and parameters, as JSON values: part of what an experiment is."""

    def fit(self, train: DataFrame, labels: Sequence[str], path: str) -> None:
        """Trains on ``dictionary, id, label, text``, one model per dictionary."""

    def apply(self, entries: DataFrame, path: str, carry: Sequence[str] = ()) -> DataFrame:
        """``dictionary, id, *carry, label_out, prob_out`` of every entry."""


@dataclass(frozen=True)
class NaiveBayesClassifier:
    def describe(self) -> dict:
        return {"classifier": "naive Bayes"}

    def fit(self, train: DataFrame, labels: Sequence[str], path: str) -> None:
        train_naive_bayes(train, labels).save(f"{path}/weights", "overwrite")

    def apply(self, entries: DataFrame, path: str, carry: Sequence[str] = ()) -> DataFrame:
        return apply_naive_bayes(entries, NaiveBayes.load(entries.sparkSession, f"{path}/weights"), carry)


@dataclass(frozen=True)
class SoftmaxClassifier:
    """Piece ids of a given vocabulary, trained by epochs at a learning rate."""

    vocabulary: Vocabulary
    max_length: int = MAX_LENGTH
    training: Training = field(default_factory=Training)

    def describe(self) -> dict:
        sizes = {"pieces": self.vocabulary.size, "max_length": self.max_length}
        return {"classifier": "softmax", **sizes, **asdict(self.training)}

    def fit(self, train: DataFrame, labels: Sequence[str], path: str) -> None:
        coded = encode_pieces(train, self.vocabulary, self.max_length)
        # encoded once, read in every epoch
        rows = stage(coded.select("dictionary", "id", "label", "input_ids", "attention_mask"), "encoded")
        train_softmax(rows, labels, self.vocabulary.size, f"{path}/weights", self.training)

    def apply(self, entries: DataFrame, path: str, carry: Sequence[str] = ()) -> DataFrame:
        model = load_softmax(entries.sparkSession, f"{path}/weights", self.training.epochs)
        coded = encode_pieces(entries, self.vocabulary, self.max_length)
        return apply_softmax(coded, model, carry)


@dataclass(frozen=True)
class OwnClassifier:
    """A model of one's own that needs no training here; ``name`` tells one version from another."""

    name: str
    load: Callable[[], BatchModel]

    def describe(self) -> dict:
        return {"classifier": self.name}

    def fit(self, train: DataFrame, labels: Sequence[str], path: str) -> None:
        pass

    def apply(self, entries: DataFrame, path: str, carry: Sequence[str] = ()) -> DataFrame:
        kept = ["dictionary", "id", *carry]
        scored = apply_function(entries.withColumn("text", F.coalesce("text", F.lit(""))), self.load)
        return scored.select(*kept, "label_out", "prob_out")

"""A train and a test set per dictionary, with one test vocabulary for all.

Labelled entries have ``dictionary, id, word, label`` and may have ``quality``.
All dictionaries are handled in one frame by their ``dictionary`` column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termtide.functions.ordering import seeded_key
from termtide.operators.joins import lookup_join
from termtide.operators.metrics import average_size, label_distribution
from termtide.operators.selection import best_quality, pick_by_quota


@dataclass(frozen=True)
class SplitSize:
    """How many test terms: a count or a share of the average dictionary.

    ``force`` tops the quotas up when rounding leaves them short of the target.
    """

    count: int | None = None
    share: float | None = None
    force: bool = True

    def __post_init__(self):
        if (self.count is None) == (self.share is None):
            raise ValueError("give either a test count or a test share")


def word_counts(labelled: DataFrame) -> DataFrame:
    """``dictionary, word, label, n``: how many entries each word has, with its label.

    Everything about the test vocabulary follows from this table, which is far
    smaller than the entries: write it once where it is used more than once.
    """
    return labelled.groupBy("dictionary", "word", "label").agg(F.count(F.lit(1)).alias("n"))


def _dictionaries(words: DataFrame, n_dictionaries: int | None) -> Column:
    if n_dictionaries:
        return F.lit(n_dictionaries)
    return words.agg(F.count_distinct("dictionary")).scalar()


def common_terms(words: DataFrame, n_dictionaries: int | None = None) -> DataFrame:
    """``word, label`` of the words every dictionary has.

    Without the number of dictionaries those with entries are counted.
    """
    return (
        words.groupBy("word", "label")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == _dictionaries(words, n_dictionaries))
        .select("word", "label")
    )


def test_target(words: DataFrame, size: SplitSize, n_dictionaries: int | None = None) -> Column:
    """The wished number of test terms, rounded half to even."""
    if size.count is not None:
        return F.lit(size.count).cast("double")
    average = average_size(words, n_dictionaries, weight="n").scalar()
    return F.bround(F.lit(size.share) * average, 0)


def test_quotas(
    words: DataFrame, size: SplitSize, n_dictionaries: int | None = None, seed: int = 0
) -> DataFrame:
    """``label, n, share, quota``: test terms per label, rounded half to even.

    A forced target that rounding falls short of is topped up by one term per
    label in seeded label order, going round again if labels are few. Quotas
    that round above the target stay.
    """
    target = test_target(words, size, n_dictionaries)
    quotas = label_distribution(words, weight="n").withColumn(
        "quota", F.bround(target * F.col("share"), 0).cast("bigint")
    )
    if not size.force:
        return quotas
    # one row per label: bounded by the label set
    everyone = Window.partitionBy(F.lit(1))
    turn = F.row_number().over(everyone.orderBy(seeded_key(F.col("label"), seed), "label")) - 1
    number = F.count(F.lit(1)).over(everyone)
    short = F.greatest(target.cast("bigint") - F.sum("quota").over(everyone), F.lit(0))
    extra = F.floor(short / number) + F.when(turn < short % number, 1).otherwise(0)
    return quotas.withColumn("quota", (F.col("quota") + extra).cast("bigint"))


def quota_shortfall(quotas: DataFrame, picked: DataFrame) -> DataFrame:
    """``label, quota, available`` of the labels with too few common terms."""
    available = picked.groupBy("label").agg(F.count(F.lit(1)).alias("available"))
    return (
        quotas.select("label", "quota")
        .join(available, "label", "left")
        .na.fill(0, ["available"])
        .filter(F.col("available") < F.col("quota"))
    )


def test_terms(
    words: DataFrame, size: SplitSize, n_dictionaries: int | None = None, seed: int = 0
) -> DataFrame:
    """``word, label`` of the test vocabulary."""
    quotas = test_quotas(words, size, n_dictionaries, seed)
    return pick_by_quota(common_terms(words, n_dictionaries), quotas, seed)


def test_entries(labelled: DataFrame, terms: DataFrame) -> DataFrame:
    return lookup_join(labelled, terms.select("word"), ["word"], "left_semi")


def train_entries(labelled: DataFrame, terms: DataFrame) -> DataFrame:
    return lookup_join(labelled, terms.select("word"), ["word"], "left_anti")


def split_dataset(labelled: DataFrame, terms: DataFrame, seed: int = 0) -> DataFrame:
    """Labelled entries with ``split``: the best entry of each test term, all entries of other words."""
    test = best_quality(test_entries(labelled, terms), seed)
    train = train_entries(labelled, terms)
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )


def dataset_all(train: DataFrame, test: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """All rows of a dataset, repeats kept."""
    parts = train if valid is None else train.unionByName(valid)
    return parts.unionByName(test)


def dataset_labels(train: DataFrame, test: DataFrame) -> DataFrame:
    """``label, in_train, in_test`` of the labels of both sets.

    Reported, not fatal: a label of one set only makes the two sets differ.
    """
    marks = train.select("label", F.lit(True).alias("train")).unionByName(
        test.select("label", F.lit(False).alias("train"))
    )
    return marks.groupBy("label").agg(
        F.bool_or(F.col("train")).alias("in_train"), F.bool_or(~F.col("train")).alias("in_test")
    )

"""Counts, scores and threshold curves of labelled and scored entries.

``label`` is the truth and ``label_out, prob_out`` the prediction. Everything is
one grouped count with partial aggregation; what follows works on tables bounded
by the label set or by the 101 points of a curve. ``by`` names columns (such as
``dictionary``) for which results are kept apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The points of a curve are 0.00, 0.01, ... 1.00.
CURVE_STEP = 0.01
CURVE_LAST = 100


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 on an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _size(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count(F.lit(1))


def label_counts(
    labelled: DataFrame, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """``label, n``; ``weight`` names a column that says how many entries a row stands for."""
    return labelled.groupBy(*by, "label").agg(_size(weight).alias("n"))


def label_distribution(labelled: DataFrame, weight: str | None = None) -> DataFrame:
    """``label, n, share``: entries per label over all dictionaries, and their share."""
    counts = label_counts(labelled, weight=weight)
    return counts.withColumn(
        "share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    )


def average_size(
    labelled: DataFrame, n_dictionaries: int | None = None, weight: str | None = None
) -> DataFrame:
    """``average_size``: labelled entries per dictionary.

    Without the number of dictionaries those that have entries are counted.
    """
    per_dictionary = labelled.groupBy("dictionary").agg(_size(weight).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("double")
    number = F.lit(n_dictionaries) if n_dictionaries else F.count(F.lit(1))
    return per_dictionary.agg(_ratio(total, number).alias("average_size"))


def value_counts(df: DataFrame, column: str = "label", by_count: bool = False) -> DataFrame:
    """``value, n`` without nulls, in the order of the values or of the counts."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.desc("n"), "value") if by_count else counts.orderBy("value")


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by, "label", "label_out").agg(F.count(F.lit(1)).alias("n"))


def accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = F.count_if(F.col("label") == F.col("label_out"))
    return scored.groupBy(*by).agg(_ratio(right, F.count(F.lit(1))).alias("accuracy"))


def _per_label(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """``label, right, support, guessed`` of every label seen in truth or prediction."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    right = F.when(F.col("label") == F.col("label_out"), n).otherwise(zero)

    def role(label: str, right: Column, support: Column, guessed: Column) -> Column:
        return F.struct(
            F.col(label).alias("label"),
            right.alias("right"),
            support.alias("support"),
            guessed.alias("guessed"),
        )

    # each cell counts for its true and for its predicted label
    roles = F.array(role("label", right, n, zero), role("label_out", zero, zero, n))
    return _sum_counts(confusion(scored, by).select(*by, F.inline(roles)), by)


def _sum_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("right", "support", "guessed")]
    return rows.filter(F.col("label").isNotNull()).groupBy(*by, "label").agg(*sums)


def _with_scores(counts: DataFrame) -> DataFrame:
    right, support, guessed = F.col("right"), F.col("support"), F.col("guessed")
    return (
        counts.withColumn("precision", _ratio(right, guessed))
        .withColumn("recall", _ratio(right, support))
        .withColumn("f1", _ratio(2 * right, guessed + support))
    )


def class_report(
    scored: DataFrame, labels: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``label, precision, recall, f1, support`` per label, with both means.

    ``labels`` adds labels (of the training set) that are in neither truth nor
    prediction. The rows ``macro avg`` and ``weighted avg`` follow.
    """
    counts = _per_label(scored, by)
    if labels is not None:
        zeros = [F.lit(0).cast("bigint").alias(c) for c in ("right", "support", "guessed")]
        listed = labels.select(*by, "label", *zeros)
        counts = _sum_counts(counts.unionByName(listed), by)
    fields = ["precision", "recall", "f1"]
    weight = F.sum("support")
    # one row per group: its label rows, bounded by the label set, and both means
    groups = (
        _with_scores(counts)
        .groupBy(*by)
        .agg(
            F.collect_list(F.struct("label", *fields, "support")).alias("rows"),
            F.struct(
                F.lit("macro avg").alias("label"),
                *[F.avg(c).alias(c) for c in fields],
                weight.alias("support"),
            ).alias("macro"),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *[_ratio(F.sum(F.col(c) * F.col("support")), weight).alias(c) for c in fields],
                weight.alias("support"),
            ).alias("weighted"),
        )
    )
    return groups.select(*by, F.inline(F.concat("rows", F.array("macro", "weighted"))))


def macro_f1(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean f1 over the labels seen in truth or prediction."""
    return _with_scores(_per_label(scored, by)).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def precision_at(scored: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """``precision`` of the entries at or above a threshold, and their ``coverage``.

    Both are 0 when no entry is that confident.
    """
    kept = F.col("prob_out") >= F.lit(float(threshold))
    right = kept & (F.col("label") == F.col("label_out"))
    return scored.groupBy(*by).agg(
        _ratio(F.count_if(right), F.count_if(kept)).alias("precision"),
        _ratio(F.count_if(kept), F.count(F.lit(1))).alias("coverage"),
    )


def _bucket(prob: Column) -> Column:
    """The last curve point not above ``prob``; null below the first one."""
    at = F.floor(prob * CURVE_LAST).cast("int")
    point = (
        F.when((at + 1) * F.lit(CURVE_STEP) <= prob, at + 1)
        .when(at * F.lit(CURVE_STEP) > prob, at - 1)
        .otherwise(at)
    )
    return F.when(prob >= 0, F.least(point, F.lit(CURVE_LAST)))


def _curve(scored: DataFrame, right: Column, by: Sequence[str]) -> DataFrame:
    """Per point: ``kept, right`` at or above it, and ``total``; one pass over the rows."""
    buckets = scored.groupBy(*by, _bucket(F.col("prob_out")).alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right")
    )
    # one row per group: at most 101 buckets, and the rows below all of them
    groups = buckets.groupBy(*by).agg(
        F.collect_list(F.struct("t", "n", "right")).alias("cells"), F.sum("n").alias("total")
    )
    points = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(CURVE_LAST))).alias("point"))

    def above(field: str) -> Column:
        reached = F.filter("cells", lambda cell: cell["t"] >= F.col("point"))
        return F.aggregate(reached, F.lit(0).cast("bigint"), lambda acc, cell: acc + cell[field])

    return points.select(
        *by,
        F.round(F.col("point") * F.lit(CURVE_STEP), 2).alias("threshold"),
        above("n").alias("kept"),
        above("right").alias("right"),
        "total",
    )


def threshold_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``threshold, precision, coverage`` at the 101 points."""
    curve = _curve(scored, F.col("label") == F.col("label_out"), by)
    return curve.select(
        *by,
        "threshold",
        _ratio(F.col("right"), F.col("kept")).alias("precision"),
        _ratio(F.col("kept"), F.col("total")).alias("coverage"),
    )


def count_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``threshold, n``: entries at or above each of the 101 points."""
    curve = _curve(scored, F.lit(False), by)
    return curve.select(*by, "threshold", F.col("kept").alias("n"))


def run_summary(
    train: DataFrame, test_scored: DataFrame, new_best: DataFrame, threshold: float
) -> DataFrame:
    """One row per dictionary: training size, test scores and new terms at a threshold.

    ``new_best`` has one scored entry per new term.
    """
    by = ["dictionary"]
    sizes = train.groupBy(*by).agg(F.count(F.lit(1)).alias("train_count"))
    labels = train.select(*by, "label").distinct()
    macro = (
        class_report(test_scored, labels, by)
        .filter(F.col("label") == "macro avg")
        .select(*by, F.col("precision").alias("macro_precision"), F.col("recall").alias("macro_recall"))
    )
    fresh = new_best.groupBy(*by).agg(
        F.count_if(F.col("prob_out") >= F.lit(float(threshold))).alias("new_terms")
    )
    summary = sizes
    for part in (
        macro_f1(test_scored, by).withColumnRenamed("macro_f1", "f_score"),
        macro,
        accuracy(test_scored, by),
        precision_at(test_scored, threshold, by),
        fresh,
    ):
        # one row per dictionary on both sides
        summary = summary.join(part, by, "left")
    return summary.na.fill(0, ["new_terms"])

"""Filters, best and first entries per word, seeded picks.

Windows over a word or a label keep a bounded number of rows of each group.
Spark then drops the rest of a group inside every task before the shuffle, so a
word that holds a third of all rows still sends few rows to one task. Above
Spark's own limit for that, and where the number kept differs per group,
``first_in_group`` is used instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termtide.functions.ordering import seed_bucket, seeded_key

# Spark prunes a ranked window before its shuffle up to this bound.
_PRUNED_RANKS = 1000
# How many ranges of the order first_in_group counts per group.
_RANGES = 4096


def with_quality_at_least(entries: DataFrame, threshold: int) -> DataFrame:
    """Entries of at least this quality; a dictionary without quality (none or null) stays whole."""
    if "quality" not in entries.columns:
        return entries
    return entries.filter(F.col("quality").isNull() | (F.col("quality") >= threshold))


def with_confidence_at_least(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("prob_out") >= F.lit(float(threshold)))


def unlabelled_positive(scored: DataFrame) -> DataFrame:
    """The report's view: no known label and, where there is a quality, a positive one."""
    kept = scored.filter(F.col("label").isNull()) if "label" in scored.columns else scored
    if "quality" not in kept.columns:
        return kept
    return kept.filter(F.col("quality").isNull() | (F.col("quality") > 0))


def _ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: Column | int) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def first_in_group(
    df: DataFrame, group: Sequence[str], ranges: Column, order: Sequence[Column], limit: str
) -> DataFrame:
    """The first ``limit`` rows (a column, equal within a group) of each group.

    ``ranges`` cuts the order of a group into ranges of ascending number. Rows
    are counted per range, which combines before the shuffle, and the running
    total tells how many rows each range may still give. Ranges past the limit
    are dropped before anything is sorted; the others are ranked range by range,
    so no task ever holds a whole group.
    """
    group = list(group)
    numbered = df.withColumn("_range", ranges)
    counted = numbered.groupBy(*group, "_range", limit).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(limit) - F.coalesce(F.sum("_n").over(before), F.lit(0))
    cut = (
        counted.withColumn("_left", left)
        .filter(F.col("_left") > 0)
        .select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_range").alias("_g_range"), "_left")
    )
    match = F.col("_range").eqNullSafe(F.col("_g_range"))
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    reached = numbered.join(cut, match).drop(*[f"_g_{g}" for g in group], "_g_range")
    ranked = _ranked(reached, [*group, "_range"], order, F.col("_left"))
    return ranked.drop("_range", "_left")


def _word_keys(entries: DataFrame) -> list[str]:
    return [c for c in ("dictionary", "word") if c in entries.columns]


def top_n_per_word(entries: DataFrame, n: int, by: str = "input") -> DataFrame:
    """The first ``n`` entries of each word (and dictionary).

    ``by='input'`` goes by ``id``, ``by='quality'`` by quality, best first. A
    dictionary without quality (no such column, or null) stays whole, as its entries
    cannot be compared.
    """
    if by not in ("input", "quality"):
        raise ValueError(f"unknown order {by!r}")
    if "quality" not in entries.columns:
        return entries
    compared = _top_n(entries.filter(F.col("quality").isNotNull()), n, by)
    return compared.unionByName(entries.filter(F.col("quality").isNull()))


def _top_n(entries: DataFrame, n: int, by: str) -> DataFrame:
    keys = _word_keys(entries)
    order = [F.asc("id")] if by == "input" else [F.desc_nulls_last("quality"), F.asc("id")]
    if n <= _PRUNED_RANKS:
        return _ranked(entries, keys, order, n)
    span = entries.agg(F.struct(F.min("id").alias("low"), F.max("id").alias("high"))).scalar()
    low, high = span["low"], span["high"]
    part = F.floor((F.col("id") - low) / (high - low + 1) * _RANGES)
    if by == "input":
        ranges = part
    else:
        # best first, unknown quality last
        ranges = F.struct(F.col("quality").isNull(), -F.col("quality"), part)
    limited = entries.withColumn("_limit", F.lit(n).cast("bigint"))
    return first_in_group(limited, keys, ranges, order, "_limit").drop("_limit")


def best_quality(entries: DataFrame, seed: int = 0) -> DataFrame:
    """One entry per word: the best quality, equal ones by a seeded draw."""
    order = [F.asc(seeded_key(F.col("id"), seed)), F.asc("id")]
    if "quality" in entries.columns:
        order = [F.desc_nulls_last("quality"), *order]
    return _ranked(entries, _word_keys(entries), order, 1)


def best_confidence(scored: DataFrame) -> DataFrame:
    """One entry per word, the most confident; equal ones by ``id``."""
    return _ranked(scored, _word_keys(scored), [F.desc_nulls_last("prob_out"), F.asc("id")], 1)


def last_wins(scored: DataFrame) -> DataFrame:
    """One label per word, that of its last entry: ``word, label_out, prob_out``."""
    return (
        scored.groupBy(*_word_keys(scored))
        .agg(F.max_by(F.struct("label_out", "prob_out"), "id").alias("_last"))
        .select(*_word_keys(scored), "_last.label_out", "_last.prob_out")
    )


def best_wins(scored: DataFrame) -> DataFrame:
    """One label per word, the most confident one: ``word, label_out, prob_out``."""
    return best_confidence(scored).select(*_word_keys(scored), "label_out", "prob_out")


def pick_by_quota(terms: DataFrame, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """Per label, the quota's number of ``word`` rows in seeded order.

    ``terms`` has ``word, label`` and ``quotas`` one row per ``label`` with its
    ``quota``. A label may hold most of the words and a quota may be any number.
    """
    wanted = quotas.select("label", F.col("quota").cast("bigint").alias("_quota"))
    # one row per label: bounded by the label set
    seeded = terms.join(F.broadcast(wanted), "label").withColumn("_seeded", seeded_key(F.col("word"), seed))
    picked = first_in_group(
        seeded, ["label"], seed_bucket(F.col("_seeded")), [F.asc("_seeded"), F.asc("word")], "_quota"
    )
    return picked.select("word", "label")


def seeded_shuffle(df: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """All rows in a reproducible random order."""
    return df.orderBy(seeded_key(F.col(key), seed), key)


def by_confidence(scored: DataFrame) -> DataFrame:
    """Best first; equal ones by ``id``."""
    return scored.orderBy(F.desc_nulls_last("prob_out"), F.asc("id"))

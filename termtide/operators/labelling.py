"""Joins of dictionary words with a lexicon, its label tree and term lists.

Lexicons and term lists are not broadcast by hint, as they may grow with the
data: ``lookup_join`` leaves the choice to the optimizer. Tables with one row
per label are, as a single label may hold most rows of the other side.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.functions.labels import first_label, label_array, strip_wildcard
from termtide.operators.joins import lookup_join
from termtide.operators.prefixes import distinct_words, match_by_sweep
from termtide.session import local_table, stage

_KEY = "_key"


class UnknownLabelError(ValueError):
    """A label that is neither used nor in the hierarchy."""


def _in_order(labels: str = "_pairs"):
    return F.transform(F.array_sort(F.col(labels)), lambda pair: pair["label"])


def label_lists(lexicon: DataFrame, repeats: bool = False) -> DataFrame:
    """One row per word with its labels in file order.

    A list holds each label once, at its first place, so its length is bounded
    by the label set however often a line is repeated. With ``repeats`` it holds the
    label of every line of its word, as the file has them.
    """
    pairs = lexicon if repeats else lexicon.groupBy("word", "label").agg(F.min("ord").alias("ord"))
    return (
        pairs.groupBy("word")
        .agg(F.collect_list(F.struct("ord", "label")).alias("_pairs"))
        .select("word", _in_order().alias("labels"))
    )


def first_labels(lexicon: DataFrame) -> DataFrame:
    """One row per word with its first label; combines before the shuffle."""
    return lexicon.groupBy("word").agg(F.min_by("label", "ord").alias("label"))


def _attach(entries: DataFrame, lists: DataFrame) -> DataFrame:
    keyed = entries.withColumn(_KEY, F.lower("word"))
    known = lists.select(F.col("word").alias(_KEY), "labels")
    return (
        lookup_join(keyed, known, [_KEY], "left")
        .withColumn("labels", F.coalesce("labels", label_array([])))
        .drop(_KEY)
    )


def label_exact(entries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entries with ``labels``, the ordered list of their word; empty when unknown.

    ``lexicon`` is either the long form or label lists. A null word matches nothing.
    """
    lists = lexicon if "labels" in lexicon.columns else label_lists(lexicon)
    return _attach(entries, lists)


def label_first(entries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Labelled entries only, each with the first ``label`` of its word.

    The first labels are written once, so that the optimizer knows their size: where they are few
    they are broadcast, and no text is shuffled to meet them.
    """
    if "labels" in lexicon.columns:
        firsts = lexicon.select("word", first_label(F.col("labels")).alias("label")).filter(
            "label IS NOT NULL"
        )
    else:
        firsts = first_labels(lexicon)
    firsts = stage(firsts, "first-labels").withColumnRenamed("word", _KEY)
    keyed = entries.withColumn(_KEY, F.lower("word"))
    return lookup_join(keyed, firsts, [_KEY], "inner").drop(_KEY)


def strict_lists(patterns: DataFrame) -> DataFrame:
    """Label lists of a pattern lexicon read strictly.

    One trailing ``*`` is dropped; where two patterns become the same word the
    later one counts. ``patterns`` has ``pattern, label, line, ord``.
    """
    per_pattern = patterns.groupBy("pattern", "line").agg(
        F.collect_list(F.struct("ord", "label")).alias("_pairs")
    )
    return (
        per_pattern.select(
            strip_wildcard(F.col("pattern")).alias("word"), "line", _in_order().alias("labels")
        )
        .groupBy("word")
        .agg(F.max_by("labels", "line").alias("labels"))
    )


def pattern_lists(patterns: DataFrame) -> DataFrame:
    """``stem, is_prefix, labels`` per pattern; the later line of a repeated pattern counts."""
    per_line = patterns.groupBy("pattern", "is_prefix", "line").agg(
        F.collect_list(F.struct("ord", "label")).alias("_pairs")
    )
    return (
        per_line.select("pattern", "is_prefix", "line", _in_order().alias("labels"))
        .groupBy("pattern", "is_prefix")
        .agg(F.max_by("labels", "line").alias("labels"))
        .select(strip_wildcard(F.col("pattern")).alias("stem"), "is_prefix", "labels")
    )


def match_patterns(words: DataFrame, stems: DataFrame) -> DataFrame:
    """The pattern of each distinct word: the whole word first, then the longest prefix.

    ``stems`` has ``stem, is_prefix, labels``. Words are sorted once and swept, see ``prefixes``.
    """
    return match_by_sweep(distinct_words(words), stems)


def label_prefix(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Entries with the ``labels`` of the pattern their word matches.

    Patterns are matched once per distinct word, not per entry.
    """
    return _attach(entries, match_patterns(entries, pattern_lists(patterns)))


def rollup_map(hierarchy: DataFrame | None, used: DataFrame) -> DataFrame:
    """Where each label goes: ``label, used_label, dangling``.

    A used label goes to itself, any other to its nearest used ancestor or, at a
    root, nowhere (null). ``dangling`` marks a chain that ends in a label the
    hierarchy does not hold. A path longer than the tree has rows is a cycle, and an
    error.
    """
    chosen = used.select(F.col("label")).distinct()
    itself = chosen.select("label", F.col("label").alias("used_label"), F.lit(False).alias("dangling"))
    if hierarchy is None:
        return itself
    steps = hierarchy.select("child", "parent").distinct()
    spark = hierarchy.sparkSession
    upward = spark.sql(
        """
        WITH RECURSIVE upward(label, node, depth) MAX RECURSION LEVEL __LEVELS__ AS (
            SELECT child, parent, 1
            FROM {steps} LEFT ANTI JOIN {chosen} ON child = {chosen}.label
            UNION ALL
            SELECT above.label, {steps}.parent, above.depth + 1
            FROM (
                SELECT upward.label, node, depth
                FROM upward LEFT ANTI JOIN {chosen} ON node = {chosen}.label
            ) above JOIN {steps} ON above.node = {steps}.child
        )
        SELECT label, max_by(node, depth) AS node, max(depth) AS depth,
               count_if(node IS NULL) > 0 AS at_root
        FROM upward GROUP BY label
        """.replace("__LEVELS__", str(steps.count() + 1)),
        steps=steps,
        chosen=chosen,
    )
    hit = chosen.select(F.col("label").alias("node"), F.col("label").alias("used_label"))
    climbed = upward.join(hit, "node", "left").select(
        "label",
        "used_label",
        (F.col("used_label").isNull() & ~F.col("at_root")).alias("dangling"),
    )
    return itself.unionByName(climbed)


def rollup_lexicon(
    lexicon: DataFrame, hierarchy: DataFrame | None, use_labels: Iterable[str]
) -> DataFrame:
    """The lexicon with labels replaced by used ones, repeats dropped, order kept.

    A label the hierarchy does not know fails the job; without a hierarchy
    labels that are not used are dropped.
    """
    used = local_table(lexicon.sparkSession, {"label": sorted(use_labels)})
    moves = rollup_map(hierarchy, used).withColumn("_known", F.lit(True))
    # one row per label of the tree, while a single label may hold most words
    joined = lexicon.select("word", "label", "ord").join(F.broadcast(moves), "label", "left")
    target = F.col("used_label")
    if hierarchy is not None:
        unknown = F.col("_known").isNull() | F.col("dangling")
        message = F.concat(F.lit("unknown label: "), F.col("label"))
        target = F.when(unknown, F.raise_error(message)).otherwise(target)
    return (
        joined.select("word", target.alias("label"), "ord")
        .filter(F.col("label").isNotNull())
        .groupBy("word", "label")
        .agg(F.min("ord").alias("ord"))
    )


def rollup_lists(
    lists: DataFrame, hierarchy: DataFrame | None, use_labels: Iterable[str]
) -> DataFrame:
    """Label lists rolled up; a word whose labels all drop is left out."""
    long = lists.select("word", F.posexplode("labels").alias("ord", "label"))
    return label_lists(rollup_lexicon(long, hierarchy, use_labels))


def label_mapped(
    entries: DataFrame,
    lexicon: DataFrame,
    hierarchy: DataFrame | None,
    use_labels: Iterable[str] | None,
) -> DataFrame:
    """``label_exact`` through the label tree; without ``use_labels`` labels stay as they are."""
    if use_labels is None:
        return label_exact(entries, lexicon)
    if "labels" in lexicon.columns:
        return label_exact(entries, rollup_lists(lexicon, hierarchy, use_labels))
    return label_exact(entries, rollup_lexicon(lexicon, hierarchy, use_labels))


def label_set(lexicon: DataFrame) -> DataFrame:
    """The distinct labels of a lexicon, long form or lists."""
    if "labels" in lexicon.columns:
        lexicon = lexicon.select(F.explode("labels").alias("label"))
    return lexicon.select("label").distinct()


def drop_exclusions(entries: DataFrame, *term_lists: DataFrame) -> DataFrame:
    """Entries whose word is in none of the term lists, whatever its case."""
    if not term_lists:
        return entries
    terms = reduce(DataFrame.union, [t.select(F.lower("term").alias(_KEY)) for t in term_lists])
    keyed = entries.withColumn(_KEY, F.lower("word"))
    return lookup_join(keyed, terms.distinct(), [_KEY], "left_anti").drop(_KEY)


def new_terms(predicted: DataFrame, lexicon: DataFrame, term: str = "word") -> DataFrame:
    """Predictions for terms the source lexicon gives no label."""
    if "labels" in lexicon.columns:
        lexicon = lexicon.filter(F.size("labels") > 0)
    known = lexicon.select(F.lower("word").alias(_KEY)).distinct()
    keyed = predicted.withColumn(_KEY, F.lower(term))
    return lookup_join(keyed, known, [_KEY], "left_anti").drop(_KEY)


def expanded_lists(expanded: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Label lists of an expanded lexicon: its own label first, else the source's.

    ``expanded`` has ``term, label`` and may carry ``ord``, by which the last of
    repeated terms counts.
    """
    lists = lexicon if "labels" in lexicon.columns else label_lists(lexicon)
    order = F.col("ord") if "ord" in expanded.columns else F.col("label")
    own = (
        expanded.groupBy(F.lower("term").alias("word"))
        .agg(F.max_by("label", order).alias("label"))
        .select("word", F.array("label").alias("labels"), F.lit(0).alias("_rank"))
    )
    source = lists.select("word", "labels", F.lit(1).alias("_rank"))
    return own.unionByName(source).groupBy("word").agg(F.min_by("labels", "_rank").alias("labels"))


def label_expanded(entries: DataFrame, expanded: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entries labelled by the expanded lexicon, the source lexicon behind it."""
    return label_exact(entries, expanded_lists(expanded, lexicon))


def definitions(entries: DataFrame, term: str) -> DataFrame:
    """All entries of one term, whatever its case."""
    return entries.filter(F.lower("word") == term.lower())

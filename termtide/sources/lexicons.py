"""Readers of the lexicon formats.

``read_lexicon_csv`` gives the long form ``word, label, ord``, the pattern format
the same with ``pattern, is_prefix, line``, and the two list formats one row per
word with ``labels``, as there a word's later row replaces its earlier ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.functions.labels import label_subset, strip_wildcard
from termtide.functions.text import strip
from termtide.operators.joins import lookup_join
from termtide.sources.fixed import WIDE_NOT_CATEGORIES
from termtide.sources.lines import numbered, place, text_lines, with_place

# Labels of one line of a pattern file are ordered within this span.
_LINE_SPAN = 1_000_000


def read_lexicon_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``word<sep>label`` lines; any line without exactly two parts fails the job."""
    lines = numbered(text_lines(spark, path), "ord")
    parts = F.split(F.lower(strip(F.col("value"))), re.escape(sep), -1)
    message = F.format_string(
        "unexpected lexicon entry at line %d: %s", F.col("ord"), F.col("value")
    )
    checked = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(message))
    return lines.select(checked.alias("p"), "ord").select(
        F.col("p")[0].alias("word"), F.col("p")[1].alias("label"), "ord"
    )


def read_lexicon_dic(spark: SparkSession, path: str) -> DataFrame:
    """Category lines ``id<TAB>name`` and pattern lines ``pattern<TAB>id<TAB>...``.

    A line whose second field is a number is a pattern line, so the two parts
    are told apart without knowing where the ``%`` lines are.
    """
    lines = numbered(text_lines(spark, path))
    fields = F.split(strip(F.col("value")), "\\s*\t\\s*")
    rows = lines.filter(~strip(F.col("value")).isin("%", "")).select("line", fields.alias("f"))
    message = F.format_string("neither category nor pattern at line %d", F.col("line"))
    second = F.coalesce(F.get("f", F.lit(1)), F.raise_error(message))
    is_body = second.rlike("^[0-9]+$")
    header = rows.filter(~is_body).select(F.col("f")[0].alias("_id"), second.alias("label"))
    body = rows.filter(is_body).select(
        F.lower(F.col("f")[0]).alias("pattern"),
        "line",
        F.posexplode(F.slice("f", 2, F.size("f"))).alias("_pos", "_id"),
    )
    # one row per category in a sound file; in a broken one most lines, so its size decides
    named = lookup_join(body, header, ["_id"], "left")
    missing = F.raise_error(F.format_string("no category with id %s", F.col("_id")))
    return named.select(
        strip_wildcard(F.col("pattern")).alias("word"),
        "pattern",
        F.col("pattern").endswith("*").alias("is_prefix"),
        F.coalesce("label", missing).alias("label"),
        "line",
        (F.col("line") * _LINE_SPAN + F.col("_pos")).alias("ord"),
    )


def read_lexicon_pipe(
    spark: SparkSession, path: str, use_labels: Iterable[str] | None = None
) -> DataFrame:
    """``word,label|label|...`` lines without a header; words keep their case.

    A word all of whose labels are left out stays, with an empty list.
    """
    rows = with_place(
        spark.read.csv(path, schema="word string, raw string", quote='"', escape='"')
    )
    labels = label_subset(F.split("raw", "\\|"), use_labels)
    return rows.groupBy("word").agg(F.max_by(labels, place()).alias("labels"))


def read_lexicon_wide(
    spark: SparkSession,
    path: str,
    use_labels: Iterable[str] | None = None,
    not_categories: Iterable[str] = WIDE_NOT_CATEGORIES,
    multi_line: bool = True,
) -> DataFrame:
    """Tool output with one row per word (``Text``) and one numeric column per category.

    Rows without lexicon words (``Dic`` not above 0) and words without a
    category are left out. A value that is no number fails the job. Labels are
    in column order; picking them needs no reshuffling of the wide rows. Values
    may hold line breaks, and each file is read by one task; ``multi_line=False`` has
    files split among tasks, for values that hold none.
    """
    rows = spark.read.csv(
        path, header=True, quote='"', escape='"', multiLine=multi_line, inferSchema=False
    )
    skip = {"Text", *not_categories}
    _, *categories = [c for c in rows.columns if c not in skip]

    def amount(name: str):
        raw = F.col(f"`{name}`")
        message = F.concat(F.lit(f"{name} is no number for word "), F.col("Text"))
        bad = raw.isNotNull() & raw.try_cast("double").isNull()
        return F.when(bad, F.raise_error(message).cast("double")).otherwise(raw.try_cast("double"))

    placed = with_place(rows).filter(F.col("Dic").try_cast("double") > 0)
    amounts = F.array(
        *[F.struct(F.lit(c).alias("label"), amount(c).alias("v")) for c in categories]
    )
    found = F.transform(F.filter(amounts, lambda a: a["v"] > 0), lambda a: a["label"])
    labels = label_subset(found, use_labels)
    return (
        placed.select(F.col("Text").alias("word"), labels.alias("labels"), place().alias("_at"))
        .filter(F.size("labels") > 0)
        .groupBy("word")
        .agg(F.max_by("labels", "_at").alias("labels"))
    )


def lexicon_of_lists(lists: DataFrame) -> DataFrame:
    """Label lists in the long form."""
    return lists.select("word", F.posexplode("labels").alias("ord", "label")).select(
        "word", "label", F.col("ord").cast("bigint").alias("ord")
    )



"""Cleaning of words, texts and vote counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as white space at the ends of a line: Unicode white space and the
# four ASCII separators. Spark's own trim() strips blanks only.
_SPACE = r"[\s\x1c-\x1f]"
_ENDS = rf"(?U)^{_SPACE}+|{_SPACE}+$"
_STRAY_PERCENT = "%(?![0-9A-Fa-f]{2})"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, _ENDS, "")


def fold_case(col: Column) -> Column:
    return F.lower(col)


def fill_text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def url_decode(col: Column) -> Column:
    """``%xx`` and ``+`` decoded; a ``%`` that starts no escape stays as it is."""
    return F.url_decode(F.regexp_replace(col, _STRAY_PERCENT, "%25"))


def join_text(*parts: Column) -> Column:
    """Parts joined by one blank and stripped; an empty part still adds its blank."""
    pieces = []
    for part in parts:
        pieces += [F.lit(" "), part]
    return strip(F.concat(*pieces[1:]))


def compose_text(tags: Column, meaning: Column, example: Column) -> Column:
    """Tags (lower case, ``#`` as blank), meaning and example as one text."""
    tag_words = F.lower(F.replace(fill_text(tags), F.lit("#"), F.lit(" ")))
    return join_text(tag_words, fill_text(meaning), fill_text(example))


def vote_count(col: Column) -> Column:
    """The count, or null when the field is not one: ``12abc`` is rejected too."""
    return F.when(col.rlike("^[0-9]+"), col.try_cast("bigint"))


def with_net_quality(df: DataFrame, likes: str, dislikes: str) -> DataFrame:
    """``quality`` = likes - dislikes; rows without two counts are dropped."""
    net = vote_count(F.col(likes)) - vote_count(F.col(dislikes))
    return df.withColumn("quality", net).filter(F.col("quality").isNotNull())


def words_of(col: Column) -> Column:
    """The lower-cased runs of letters of a text, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+)"), F.lit(1))

"""Readers of the dictionary formats: ``id, word, text`` and, when known, ``quality``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.functions.text import (
    compose_text,
    fill_text,
    fold_case,
    join_text,
    url_decode,
    with_net_quality,
)
from termtide.sources.fixed import VOTE_COLUMNS
from termtide.sources.lines import numbered, text_lines

# Quality of entries that were reviewed before publication.
REVIEWED_QUALITY = 100


def _csv(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return spark.read.csv(
        path,
        schema=schema,
        header=True,
        quote='"',
        escape='"',
        multiLine=multi_line,
        nullValue="\0",  # an empty field is null, a quoted empty one an empty text
    )


def read_dictionary_csv(
    spark: SparkSession,
    path: str,
    schema: str = "id bigint, word string, text string, quality int",
    multi_line: bool = True,
) -> DataFrame:
    """A cleaned dictionary with a header, as it is.

    Texts may hold line breaks, and each file is read by one task. Where no text holds
    one, ``multi_line=False`` has files split among tasks; it tears texts that do.
    """
    return _csv(spark, path, schema, multi_line)


def clean_votes(raw: DataFrame) -> DataFrame:
    """Vote entries, one column per field and ``id``, as a dictionary with net votes as quality."""
    decoded = (
        raw.withColumn("word", fold_case(url_decode(fill_text(F.col("word")))))
        .withColumn("meaning", url_decode(fill_text(F.col("meaning"))))
        .withColumn("example", url_decode(fill_text(F.col("example"))))
    )
    text = compose_text(F.col("tagList"), F.col("meaning"), F.col("example"))
    return with_net_quality(decoded, "numLikes", "numDislikes").select(
        "id", "word", text.alias("text"), "quality"
    )


def read_dictionary_votes(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated entries with votes and tags; ``id`` is the line number.

    Fields are not quoted. The header, and lines without two vote counts, are dropped.
    """
    header = "|".join(VOTE_COLUMNS)
    lines = numbered(text_lines(spark, path), "_line")
    fields = F.split("value", "\\|", -1)
    return clean_votes(
        lines.filter(F.col("value") != header).select(
            (F.col("_line") - 1).alias("id"),
            *[F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(VOTE_COLUMNS)],
        )
    )


def clean_reviewed(raw: DataFrame) -> DataFrame:
    """Reviewed entries: meaning and example as text, quality constant."""
    text = join_text(fill_text(F.col("meaning")), fill_text(F.col("example")))
    return raw.select(
        "id",
        fold_case(F.col("word")).alias("word"),
        text.alias("text"),
        F.lit(REVIEWED_QUALITY).alias("quality"),
    )


def read_dictionary_reviewed(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Reviewed entries with word, meaning and example."""
    schema = "id bigint, word string, meaning string, example string"
    return clean_reviewed(_csv(spark, path, schema, multi_line))


def read_dictionary_pos(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Entries with a part of speech; ``id`` is the record number, there is no quality."""
    rows = numbered(_csv(spark, path, "word string, pos string, text string", multi_line), "id")
    return rows.select(
        "id", fold_case(F.col("word")).alias("word"), "pos", fill_text(F.col("text")).alias("text")
    )

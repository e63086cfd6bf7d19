"""Term lists, for exclusions."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.functions.text import strip
from termtide.session import local_table
from termtide.sources.lines import text_lines


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """``term``: one per line, stripped, lower-cased, without blanks and repeats."""
    terms = text_lines(spark, path).select(F.lower(strip(F.col("value"))).alias("term"))
    return terms.filter(F.col("term") != "").distinct()


def stop_words(spark: SparkSession, language: str = "english") -> DataFrame:
    """The stop words Spark ML holds for a language, as ``term``."""
    words = sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(language)})
    return local_table(spark, {"term": words})

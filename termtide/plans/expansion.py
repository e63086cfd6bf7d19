"""From scored dictionaries to expanded lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.operators.labelling import new_terms
from termtide.operators.selection import best_wins, last_wins, with_confidence_at_least


def expand_lexicon(
    scored: DataFrame, lexicon: DataFrame, threshold: float = 0.0, keep: str = "last"
) -> DataFrame:
    """``[dictionary,] term, label, prob_out`` of confident labels for words the lexicon lacks.

    Of a word's confident entries the last one counts, or the most confident
    one with ``keep='best'``. One label per word is left before the join with
    the lexicon, so a frequent word is no burden there. Words that differ in case only
    are one term, in lower case.
    """
    if keep not in ("last", "best"):
        raise ValueError(f"unknown choice {keep!r}")
    confident = with_confidence_at_least(scored, threshold).withColumn("word", F.lower("word"))
    single = last_wins(confident) if keep == "last" else best_wins(confident)
    fresh = new_terms(single, lexicon)
    names = ["dictionary"] if "dictionary" in fresh.columns else []
    return fresh.select(
        *names, F.col("word").alias("term"), F.col("label_out").alias("label"), "prob_out"
    )

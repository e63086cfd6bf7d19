"""Question texts for a labelling service.

The sentences are fixed values: cached answers are found by the exact text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentences of a question.
CONTEXT_HEAD = "In the following context: \n"
CONTEXT_BODY = '"%s", \n'
DETAILS_HEAD = "For a word with the following meaning: \n"
DETAILS_MEANING = '"%s\n"'
DETAILS_EXAMPLE_HEAD = "in this example: \n"
DETAILS_EXAMPLE = '"%s" \n'
QUESTION = 'which label should be assigned to the word "%s" from the following "%s" labels: %s?'
LABEL_ONLY = "\nRespond with label only"
FEW_SHOT_HEAD = "Using the following %s labels for the following words as example:\n"
FEW_SHOT_LINE = '"%s" labeled as "%s"\n'
FEW_SHOT_LEXICON = "LIWC 2015"


def _required(col: Column, name: str) -> Column:
    present = col.isNotNull() & (col != "")
    return F.when(present, col).otherwise(F.raise_error(F.lit(f"prompt without {name}")))


def _question(word: Column, lexicon_name: str, labels: Iterable[str]) -> Column:
    names = ", ".join(label.lower() for label in labels)
    return F.format_string(QUESTION, _required(word, "word"), F.lit(lexicon_name), F.lit(names))


def prompt_context(
    word: Column, context: Column, lexicon_name: str, labels: Iterable[str]
) -> Column:
    """Asks for the label of a word in a context."""
    return F.concat(
        F.lit(CONTEXT_HEAD),
        F.format_string(CONTEXT_BODY, _required(context, "context")),
        _question(word, lexicon_name, labels),
    )


def prompt_details(
    word: Column, definition: Column, example: Column, lexicon_name: str, labels: Iterable[str]
) -> Column:
    """Asks for the label of a word given its meaning and an example."""
    return F.concat(
        F.lit(DETAILS_HEAD),
        F.format_string(DETAILS_MEANING, _required(definition, "definition")),
        F.lit(DETAILS_EXAMPLE_HEAD),
        F.format_string(DETAILS_EXAMPLE, _required(example, "example")),
        _question(word, lexicon_name, labels),
    )


def prompt(
    word: Column,
    text: Column,
    lexicon_name: str,
    labels: Iterable[str],
    example: Column | None = None,
    label_only: bool = False,
) -> Column:
    """The context question, or the detailed one for rows that have an example."""
    labels = list(labels)
    asked = prompt_context(word, text, lexicon_name, labels)
    if example is not None:
        detailed = prompt_details(word, text, example, lexicon_name, labels)
        asked = F.when(example.isNull(), asked).otherwise(detailed)
    return F.concat(asked, F.lit(LABEL_ONLY)) if label_only else asked


# Every prompt holds all worked examples; a table beyond this is no set of examples.
MAX_EXAMPLES = 1000


def few_shot_prefix(examples: DataFrame, lexicon_name: str = FEW_SHOT_LEXICON) -> DataFrame:
    """One row, the text of all worked examples (``word, label`` and maybe ``ord``), put before each question.

    The examples are in the given order, that of ``ord``; without one in the order of their words. More than
    ``MAX_EXAMPLES`` fail the job.
    """
    line = F.format_string(FEW_SHOT_LINE, "word", "label").alias("line")
    order = ["ord"] if "ord" in examples.columns else []
    lines = F.array_sort(F.collect_list(F.struct(*order, "word", "label", line)))
    text = F.array_join(F.transform(lines, lambda e: e["line"]), "")
    message = F.lit(f"more than {MAX_EXAMPLES} worked examples")
    checked = F.when(F.count(F.lit(1)) <= MAX_EXAMPLES, text).otherwise(F.raise_error(message))
    few = examples.limit(MAX_EXAMPLES + 1)
    return few.agg(F.concat(F.lit(FEW_SHOT_HEAD % lexicon_name), checked).alias("prefix"))

"""Labels for entries from a labelling service."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtide.functions.labels import answer_labels, first_label
from termtide.functions.prompts import few_shot_prefix, prompt
from termtide.operators.asking import AnswerBatch, ask, unanswered, with_known_answers, with_prompt_key
from termtide.session import stage
from termtide.sources.tables import append_answers, known_answers


def ask_labels(
    entries: DataFrame,
    load: Callable[[], AnswerBatch],
    labels: Iterable[str],
    lexicon_name: str,
    model: str,
    answers_path: str,
    label_only: bool = False,
    examples: DataFrame | None = None,
    parallel_calls: int | None = None,
) -> DataFrame:
    """Entries (``word, text`` and maybe ``example``) with ``prompt, answer, label_out``.

    Prompts answered before are looked up; the others are asked once each and
    their answers recorded before anything uses them. ``examples``
    (``word, label``) are put before each question, in the order of the words.
    """
    labels = list(labels)
    example: Column | None = F.col("example") if "example" in entries.columns else None
    question = prompt(F.col("word"), F.col("text"), lexicon_name, labels, example, label_only)
    if examples is not None:
        question = F.concat(few_shot_prefix(examples, lexicon_name).scalar(), question)
    prompts = stage(with_prompt_key(entries.withColumn("prompt", question), model), "prompts")

    spark = entries.sparkSession
    misses = unanswered(prompts, known_answers(spark, answers_path))
    append_answers(ask(misses, load, parallel_calls), answers_path)

    answered = with_known_answers(prompts, known_answers(spark, answers_path))
    found = first_label(answer_labels(F.col("answer"), labels))
    return answered.withColumn("label_out", found).drop("prompt_hash")

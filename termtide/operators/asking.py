"""Labels asked from a service, with a table of the answers already given.

Answers are keyed by model and prompt. Prompts are compared by hash, so the long
texts are shuffled once at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.operators.joins import lookup_join

AnswerBatch = Callable[[list[str]], list[str]]

_ANSWERS = "model string, prompt_hash string, prompt string, answer string"


def with_prompt_key(prompts: DataFrame, model: str) -> DataFrame:
    return prompts.withColumn("model", F.lit(model)).withColumn("prompt_hash", F.sha2("prompt", 256))


def with_known_answers(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts with the ``answer`` on record, null where there is none."""
    known = answers.groupBy("model", "prompt_hash").agg(F.max("answer").alias("answer"))
    return lookup_join(prompts, known, ["model", "prompt_hash"], "left")


def unanswered(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """``model, prompt_hash, prompt``: each prompt without an answer, once."""
    # repeats go first: one prompt may be asked by most rows
    once = prompts.groupBy("model", "prompt_hash").agg(F.any_value("prompt").alias("prompt"))
    known = answers.select("model", "prompt_hash")
    return lookup_join(once, known, ["model", "prompt_hash"], "left_anti")


def ask(
    misses: DataFrame, load: Callable[[], AnswerBatch], parallel_calls: int | None = None
) -> DataFrame:
    """Answers for the prompts, batch by batch.

    ``load`` is called once per task and returns a function from prompts to
    answers. ``parallel_calls`` sets the number of tasks, hence of callers. A
    task that is run again asks again: write the result before using it.
    """
    if parallel_calls:
        misses = misses.repartition(parallel_calls, "prompt_hash")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reply = load()
        for batch in batches:
            yield batch.assign(answer=reply(batch["prompt"].tolist()))

    return misses.select("model", "prompt_hash", "prompt").mapInPandas(answer, _ANSWERS)

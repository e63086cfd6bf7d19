"""Valid entries of dictionaries that arrive as a stream.

The lexicon and the exclusions are tables; a stream of entries is joined with them as a batch is. The first
``top_n`` entries of a word need memory of what came before: the state of a dictionary's word is how many of its
entries have been let through, one small number per word. Entries of one micro-batch are taken by id, so that
batches that follow one another in the order of ids give what ``valid_entries`` gives for all at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termtide.operators.labelling import drop_exclusions, first_labels
from termtide.operators.selection import with_quality_at_least
from termtide.plans.dataset import EntryRules

_HELD = "taken int"


def label_stream(entries: DataFrame, lexicon: DataFrame, exclusions: Sequence[DataFrame] = ()) -> DataFrame:
    """Arriving entries with the first label of their word; entries of other words drop."""
    firsts = first_labels(drop_exclusions(lexicon, *exclusions)).withColumnRenamed("word", "_key")
    return entries.withColumn("_key", F.lower("word")).join(firsts, "_key").drop("_key")


def first_of_each_word(entries: DataFrame, top_n: int) -> DataFrame:
    """The first ``top_n`` arriving entries per dictionary and word; words are told apart by case, as in a batch."""
    columns = entries.columns

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.get[0] if state.exists else 0
        room = top_n - taken
        best: pd.DataFrame | None = None
        for batch in batches:
            if room > 0:  # no more than this many rows are held at a time
                best = (batch if best is None else pd.concat([best, batch])).nsmallest(room, "id")
        if best is not None and len(best):
            state.update((taken + len(best),))
            yield best[columns]

    return entries.groupBy("dictionary", "word").applyInPandasWithState(
        take, entries.schema, _HELD, "append", GroupStateTimeout.NoTimeout
    )


def valid_entries_stream(
    entries: DataFrame, lexicon: DataFrame, exclusions: Sequence[DataFrame] = (), rules: EntryRules | None = None
) -> DataFrame:
    """``valid_entries`` of a stream: labelled, not excluded, first of each word, above the threshold.

    Top-n goes by arrival only: the best entries of a stream are not known before its end.
    """
    rules = rules or EntryRules()
    kept = label_stream(entries, lexicon, exclusions)
    if rules.top_n is not None:
        if rules.top_by != "input":
            raise ValueError("of a stream the first entries can be taken, not the best")
        kept = first_of_each_word(kept, rules.top_n)
    if rules.quality_threshold is not None:
        kept = with_quality_at_least(kept, rules.quality_threshold)
    return kept

"""From dictionaries and a lexicon to a train and a test set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from termtide.operators.labelling import drop_exclusions, label_first
from termtide.operators.selection import top_n_per_word, with_quality_at_least
from termtide.operators.splitting import (
    SplitSize,
    quota_shortfall,
    split_dataset,
    test_quotas,
    test_terms,
    word_counts,
)
from termtide.session import stage


class TooFewTermsError(ValueError):
    """A label has fewer common terms than its quota."""


@dataclass(frozen=True)
class EntryRules:
    """Which labelled entries are valid.

    The first ``top_n`` entries per word are taken before the quality threshold
    is applied, so a word may end up with fewer.
    """

    top_n: int | None = None
    top_by: str = "input"
    quality_threshold: int | None = None


def valid_entries(
    entries: DataFrame,
    lexicon: DataFrame,
    exclusions: Sequence[DataFrame] = (),
    rules: EntryRules = EntryRules(),
) -> DataFrame:
    """Labelled entries of words not excluded, then top-n per word, then the threshold.

    Exclusions go by word, so they are taken off the lexicon, and the entries
    are joined once.
    """
    kept = label_first(entries, drop_exclusions(lexicon, *exclusions))
    if rules.top_n is not None:
        kept = top_n_per_word(kept, rules.top_n, rules.top_by)
    if rules.quality_threshold is not None:
        kept = with_quality_at_least(kept, rules.quality_threshold)
    return kept


def make_dataset(
    valid: DataFrame,
    size: SplitSize,
    n_dictionaries: int | None = None,
    seed: int = 0,
    strict: bool = False,
) -> DataFrame:
    """Valid entries with their ``split``; the test words are the same in every dictionary.

    The entries feed the test vocabulary and both sets, so they are written
    once first, then their words, then the vocabulary. ``strict`` fails when a
    label has fewer common terms than wanted; otherwise the test set is smaller.
    """
    valid = stage(valid, "valid-entries")
    words = stage(word_counts(valid), "word-counts")
    terms = stage(test_terms(words, size, n_dictionaries, seed), "test-terms")
    if strict:
        short = quota_shortfall(test_quotas(words, size, n_dictionaries, seed), terms)
        first = short.first()
        if first:
            raise TooFewTermsError(
                f"label {first['label']}: {first['quota']} terms wanted, {first['available']} found"
            )
    return split_dataset(valid, terms, seed)

"""Dictionaries with and without quality side by side, and entries no model knows."""

from termtide.operators.classify import apply_naive_bayes, train_naive_bayes
from termtide.operators.selection import top_n_per_word, unlabelled_positive, with_quality_at_least
from termtide.plans.expansion import expand_lexicon

SCHEMA = "dictionary string, id bigint, word string, quality int"
ROWS = [("votes", 1, "reef", -1), ("votes", 2, "reef", 4), ("votes", 3, "reef", 9)]
ROWS += [("pos", i, "reef", None) for i in range(4, 9)]


def test_no_quality_is_no_bad_quality(spark):
    entries = spark.createDataFrame(ROWS, SCHEMA)
    kept = with_quality_at_least(top_n_per_word(entries, 2), 0)
    assert sorted(r["id"] for r in kept.collect()) == [2, 4, 5, 6, 7, 8]
    best = top_n_per_word(entries, 1, "quality")
    assert sorted(r["id"] for r in best.collect()) == [3, 4, 5, 6, 7, 8]
    assert unlabelled_positive(entries).count() == 7


def test_entries_of_an_untrained_dictionary_stay(spark):
    train = spark.createDataFrame(
        [("a", "x", "salt sea"), ("a", "y", "dry land")], "dictionary string, label string, text string"
    )
    entries = spark.createDataFrame(
        [("a", 1, "salt"), ("b", 2, "salt"), ("b", 3, None)], "dictionary string, id bigint, text string"
    )
    model = train_naive_bayes(train, ["x", "y"])
    got = {r["id"]: r["label_out"] for r in apply_naive_bayes(entries, model).collect()}
    assert got == {1: "x", 2: None, 3: None}


def test_expanded_terms_fold_case(spark):
    scored = spark.createDataFrame(
        [(1, "Tide", "thing", 0.9), (2, "tide", "act", 0.8)], "id bigint, word string, label_out string, prob_out double"
    )
    lexicon = spark.createDataFrame([], "word string, label string, ord bigint")
    assert [tuple(r) for r in expand_lexicon(scored, lexicon).collect()] == [("tide", "act", 0.8)]

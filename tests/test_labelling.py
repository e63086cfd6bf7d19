import pytest
from pyspark.sql import functions as F

from termtide.functions.labels import (
    answer_labels,
    best_label,
    best_probability,
    first_label,
    label_array,
    label_subset,
    softmax,
    strip_wildcard,
)
from termtide.functions.text import compose_text, strip, url_decode
from termtide.operators import labelling
from termtide.sources.fixed import PSYCH_2015_TREE, VALUES_TREE, VALUES_USED, hierarchy_table

TREE = {
    "plant": None,
    "tree": "plant",
    "herb": "plant",
    "mint": "herb",
    "oak": "tree",
    "acorn": "oak",
    "stone": None,
}


def lexicon_of(spark, *pairs):
    rows = [(w, l, i) for i, (w, l) in enumerate(pairs)]
    return spark.createDataFrame(rows, "word string, label string, ord bigint")


def entries_of(spark, *words):
    return spark.createDataFrame(list(enumerate(words)), "id bigint, word string")


def labels_by_id(df):
    return [list(r["labels"]) for r in df.orderBy("id").collect()]


@pytest.fixture
def values(spark):
    return lexicon_of(
        spark,
        ("oar", "order"),
        ("rope", "truth"),
        ("oar", "life"),
        ("nest", "family"),
        ("rule", "religion"),
        ("star", "life"),
        ("star", "order"),
    )


def test_exact(spark, values):
    entries = entries_of(spark, "Oar", "nest", "mist", None)
    assert labels_by_id(labelling.label_exact(entries, values)) == [["order", "life"], ["family"], [], []]


def test_first(spark, values):
    entries = entries_of(spark, "Oar", "star", "mist", None)
    rows = labelling.label_first(entries, values).orderBy("id").collect()
    assert [(r["word"], r["label"]) for r in rows] == [("Oar", "order"), ("star", "life")]
    lists = labelling.label_lists(values)
    again = labelling.label_first(entries, lists).orderBy("id").collect()
    assert again == rows


def test_rollup_map(spark):
    used = spark.createDataFrame([("plant",), ("tree",)], "label string")
    moves = labelling.rollup_map(hierarchy_table(spark, TREE), used).collect()
    assert {r["label"]: r["used_label"] for r in moves} == {
        "plant": "plant",
        "tree": "tree",
        "herb": "plant",
        "mint": "plant",
        "oak": "tree",
        "acorn": "tree",
        "stone": None,
    }
    assert not any(r["dangling"] for r in moves)


def test_rollup_lists_drop_repeats(spark):
    lexicon = lexicon_of(spark, ("a", "plant"), ("a", "mint"), ("b", "stone"), ("c", "acorn"), ("c", "plant"))
    grown = labelling.rollup_lexicon(lexicon, hierarchy_table(spark, TREE), ["plant", "tree"])
    rows = labelling.label_lists(grown).collect()
    assert {r["word"]: list(r["labels"]) for r in rows} == {"a": ["plant"], "c": ["tree", "plant"]}


def test_mapped(spark, values):
    tree = {"life": None, "order": None, "family": None, "social": "order", "truth": "life", "religion": "order"}
    entries = entries_of(spark, "oar", "nest", "rule", "star", "mist")
    labelled = labelling.label_mapped(entries, values, hierarchy_table(spark, tree), ["life", "family"])
    assert labels_by_id(labelled) == [["life"], ["family"], [], ["life"], []]
    as_is = labelling.label_mapped(entries, values, None, None)
    assert labels_by_id(as_is)[0] == ["order", "life"]
    # without a tree labels that are not used drop
    no_tree = labelling.label_mapped(entries, values, None, ["order"])
    assert labels_by_id(no_tree) == [["order"], [], [], ["order"], []]


def test_mapped_values_tree(spark, values):
    entries = entries_of(spark, "Oar", "rule", "star", "nest")
    labelled = labelling.label_mapped(entries, values, hierarchy_table(spark, VALUES_TREE), VALUES_USED)
    assert labels_by_id(labelled) == [["order", "life"], ["religion"], ["life", "order"], ["social"]]


@pytest.mark.parametrize("tree", [{"life": None}, {"life": None, "truth": "gone", "religion": None, "order": None, "family": None}])
def test_unknown_label_fails(spark, values, tree):
    with pytest.raises(Exception, match="unknown label"):
        labelling.rollup_lexicon(values, hierarchy_table(spark, tree), ["life"]).collect()


def test_cycle_fails(spark, values):
    tree = {"order": "truth", "truth": "order", "life": None, "family": None, "religion": None}
    with pytest.raises(Exception, match="(?i)recursi"):
        labelling.rollup_lexicon(values, hierarchy_table(spark, tree), ["life"]).collect()


def test_deep_tree(spark):
    deep = {"n0": None, **{f"n{i}": f"n{i - 1}" for i in range(1, 301)}}
    used = spark.createDataFrame([("n0",)], "label string")
    moves = labelling.rollup_map(hierarchy_table(spark, deep), used).collect()
    assert len(moves) == 301 and {r["used_label"] for r in moves} == {"n0"}


def test_trees_are_closed():
    for tree in (PSYCH_2015_TREE, VALUES_TREE):
        assert all(parent is None or parent in tree for parent in tree.values())
    assert set(VALUES_USED) <= set(VALUES_TREE)


def test_exclusions(spark):
    entries = entries_of(spark, "Anna", "the", "car", "bob")
    names = spark.createDataFrame([("anna",), ("BOB",)], "term string")
    words = spark.createDataFrame([("The",)], "term string")
    kept = labelling.drop_exclusions(entries, names, words)
    assert [r["word"] for r in kept.collect()] == ["car"]
    assert labelling.drop_exclusions(entries).count() == 4


def test_new_terms_and_expanded(spark, values):
    predicted = spark.createDataFrame(
        [("Oar", "x"), ("Drift", "act"), ("tide", "thing")], "term string, label string"
    )
    fresh = labelling.new_terms(predicted, values, "term")
    assert sorted(r["term"] for r in fresh.collect()) == ["Drift", "tide"]
    entries = entries_of(spark, "drift", "TIDE", "oar", "mist")
    found = labelling.label_expanded(entries, fresh, values)
    assert labels_by_id(found) == [["act"], ["thing"], ["order", "life"], []]
    # a word whose list is empty has no label yet
    lists = spark.createDataFrame([("tide", [])], "word string, labels array<string>")
    assert labelling.new_terms(predicted, lists, "term").count() == 3


def test_definitions(spark):
    entries = entries_of(spark, "cat", "Cat", "dog")
    assert [r["id"] for r in labelling.definitions(entries, "CAT").orderBy("id").collect()] == [0, 1]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, text",
    [("b%20stalking", "b stalking"), ("a+b%2Bc", "a b+c"), ("100%", "100%"), ("%zz%41", "%zzA"), ("%C3%A9", "é"), ("", "")],
)
def test_url_decode(spark, raw, text):
    assert one(spark, url_decode(F.lit(raw))) == text


def test_text(spark):
    assert one(spark, strip(F.lit(" \t a b \n"))) == "a b"
    composed = compose_text(F.lit("#Tag#X"), F.lit(""), F.lit("Ex"))
    assert one(spark, composed) == "tag x  Ex"
    assert one(spark, compose_text(F.lit(None).cast("string"), F.lit("M"), F.lit(None).cast("string"))) == "M"


def test_label_expressions(spark):
    labels = label_array(["a", "b", "c"])
    assert one(spark, label_subset(labels, {"c", "a"})) == ["a", "c"]
    assert one(spark, label_subset(labels, None)) == ["a", "b", "c"]
    assert one(spark, first_label(labels)) == "a"
    assert one(spark, first_label(label_array([]))) is None
    assert one(spark, strip_wildcard(F.lit("a**"))) == "a*"


def test_softmax(spark):
    scores = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0), F.lit(-1000.0))
    probs = one(spark, softmax(scores))
    assert sum(probs) == pytest.approx(1)
    assert probs[1] == pytest.approx(0.4683105, rel=1e-6)
    assert one(spark, best_probability(scores)) == pytest.approx(probs[1])
    assert one(spark, best_label(scores, label_array(["a", "b", "c", "d"]))) == "b"


@pytest.mark.parametrize(
    "answer, labels",
    [
        ("I think Social, then bio", ["social", "bio"]),
        ("biology", ["bio"]),
        ("none", []),
        ("affect affection", ["affect", "affection"]),
    ],
)
def test_answer_labels(spark, answer, labels):
    known = ["Affect", "affection", "bio", "social"]
    assert one(spark, answer_labels(F.lit(answer), known)) == labels


def test_answer_labels_whole_word(spark):
    known = ["bio", "affect"]
    assert one(spark, answer_labels(F.lit("biology affect bio."), known, whole_word=True)) == ["affect", "bio"]


def test_few_first_labels_are_met_without_a_shuffle_of_texts(spark):
    entries = spark.range(2000).select("id", F.lit("d").alias("dictionary"), F.concat(F.lit("W"), F.col("id") % 50).alias("word"), F.lit("x").alias("text"))
    # few words, but the optimizer cannot tell
    lexicon = spark.range(5_000_000).filter("id < 40").select(F.concat(F.lit("w"), "id").alias("word"), F.lit("a").alias("label"), F.col("id").alias("ord"))
    labelled = labelling.label_first(entries, lexicon)
    assert "SortMergeJoin" not in labelled._jdf.queryExecution().executedPlan().toString()
    assert labelled.count() == 2000 // 50 * 40 and {r.label for r in labelled.collect()} == {"a"}

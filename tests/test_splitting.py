import pytest
from pyspark.sql import functions as F

from termtide.operators import splitting
from termtide.operators.splitting import SplitSize, test_quotas as quotas_of
from termtide.plans.dataset import EntryRules, TooFewTermsError, make_dataset, valid_entries

LABELS = {"l1": 65, "l2": 63, "l3": 53, "l4": 51, "l5": 68}


def label_of(i):
    for label, n in LABELS.items():
        if i < n:
            return label
        i -= n
    raise IndexError


@pytest.fixture(scope="module")
def lexicon(spark):
    # 20 words after the dictionary's 300 take the labels round robin
    rows = [(f"word{i}", label_of(i) if i < 300 else f"l{i % 5 + 1}", i) for i in range(320)]
    return spark.createDataFrame(rows, "word string, label string, ord bigint")


def dictionary(spark, name, words):
    rows = [(name, i, f"Word{w}" if w % 2 else f"word{w}", f"text {w}", i % 13 - 2) for i, w in enumerate(words)]
    rows += [(name, 9000 + i, w, "", 3) for i, w in enumerate(("unknown", "other"))]
    return spark.createDataFrame(
        rows, "dictionary string, id bigint, word string, text string, quality int"
    ).withColumn("word", F.lower("word"))


@pytest.fixture(scope="module")
def one_dictionary(spark, lexicon):
    return valid_entries(dictionary(spark, "d0", range(300)), lexicon).cache()


def counts(df, *keys):
    return {tuple(r[k] for k in keys): r["count"] for r in df.groupBy(*keys).count().collect()}


def test_rounded_share(one_dictionary):
    words = splitting.word_counts(one_dictionary)
    rows = quotas_of(words, SplitSize(share=0.1, force=False)).collect()
    # 30 * 65 / 300 = 6.5 goes to the even number
    assert {r["label"]: r["quota"] for r in rows} == {"l1": 6, "l2": 6, "l3": 5, "l4": 5, "l5": 7}


@pytest.mark.parametrize("size", [SplitSize(share=0.1), SplitSize(count=30)])
def test_forced_size(one_dictionary, size):
    dataset = make_dataset(one_dictionary, size, strict=True)
    assert counts(dataset, "split") == {("train",): 270, ("test",): 30}


def test_top_up_goes_round_again(spark):
    words = spark.createDataFrame(
        [("d0", f"w{i}", label, 1) for i, label in enumerate("aabb")],
        "dictionary string, word string, label string, n bigint",
    )
    rows = quotas_of(words, SplitSize(count=5)).collect()
    # 2.5 each rounds to 2
    assert sorted(r["quota"] for r in rows) == [2, 3]


def test_size_is_count_or_share():
    with pytest.raises(ValueError):
        SplitSize()
    with pytest.raises(ValueError):
        SplitSize(count=1, share=0.1)


def test_sets_share_no_word_and_terms_are_common(spark, lexicon):
    entries = dictionary(spark, "d0", range(300)).unionByName(
        dictionary(spark, "d1", [*range(50, 320), *range(50, 320)])
    )
    valid = valid_entries(entries, lexicon)
    dataset = make_dataset(valid, SplitSize(count=40), n_dictionaries=2).cache()
    words = {
        (d, s): {r["word"] for r in dataset.filter(f"dictionary = '{d}' AND split = '{s}'").collect()}
        for d in ("d0", "d1")
        for s in ("train", "test")
    }
    assert words["d0", "test"] == words["d1", "test"]
    assert not words["d0", "test"] & words["d0", "train"]
    assert not words["d1", "test"] & words["d1", "train"]
    assert counts(dataset.filter("split = 'test'"), "dictionary") == {("d0",): 40, ("d1",): 40}
    assert "unknown" not in words["d0", "train"]
    # all entries of the other words are kept
    assert dataset.filter("dictionary = 'd1' AND split = 'train'").count() == 540 - 2 * 40


def test_test_entry_is_the_best_one(spark):
    rows = [("d0", i, f"w{i % 6}", i, "l") for i in range(60)]
    valid = spark.createDataFrame(rows, "dictionary string, id bigint, word string, quality int, label string")
    dataset = make_dataset(valid, SplitSize(count=4))
    test = dataset.filter("split = 'test'").collect()
    assert len(test) == 4 and all(r["quality"] == 54 + int(r["word"][1:]) for r in test)


def test_a_dictionary_without_entries_leaves_no_common_terms(one_dictionary):
    words = splitting.word_counts(one_dictionary)
    assert splitting.common_terms(words, 1).count() == 300
    assert splitting.common_terms(words, 2).count() == 0


def test_too_few_terms(spark):
    rows = [("d0", i, f"w{i % 3}", 1, "l") for i in range(30)]
    valid = spark.createDataFrame(rows, "dictionary string, id bigint, word string, quality int, label string")
    assert make_dataset(valid, SplitSize(count=5)).filter("split = 'test'").count() == 3
    with pytest.raises(TooFewTermsError, match="5 terms wanted, 3 found"):
        make_dataset(valid, SplitSize(count=5), strict=True)


def test_rules_apply_in_order(spark):
    lexicon = spark.createDataFrame([("a", "x", 0), ("b", "y", 1)], "word string, label string, ord bigint")
    rows = [(1, "a", "", 1), (2, "A", "", 9), (3, "a", "", 9), (4, "b", "", 9), (5, "c", "", 9)]
    entries = spark.createDataFrame(rows, "id bigint, word string, text string, quality int").withColumn(
        "word", F.lower("word")
    )
    names = spark.createDataFrame([("B",)], "term string")

    def ids(**rules):
        out = valid_entries(entries, lexicon, [names], EntryRules(**rules))
        return sorted(r["id"] for r in out.collect())

    assert ids() == [1, 2, 3]
    # the threshold comes after the top entries were taken
    assert ids(top_n=2, quality_threshold=5) == [2]
    assert ids(top_n=2, top_by="quality", quality_threshold=5) == [2, 3]


def test_labels_of_both_sets(spark):
    train = spark.createDataFrame([("a",), ("b",), ("a",)], "label string")
    test = spark.createDataFrame([("b",), ("c",)], "label string")
    rows = splitting.dataset_labels(train, test).collect()
    assert {r["label"]: (r["in_train"], r["in_test"]) for r in rows} == {
        "a": (True, False),
        "b": (True, True),
        "c": (False, True),
    }
    assert splitting.dataset_all(train, test).count() == 5
    assert splitting.dataset_all(train, test, train).count() == 8

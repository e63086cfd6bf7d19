import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termtide.operators import selection
from termtide.operators.selection import first_in_group, pick_by_quota, top_n_per_word


def frame(spark, rows, schema="id bigint, word string, quality int"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 entries, a third of them of one word, some without quality."""
    rows = [
        (i * 7 % 3001, "hot" if i % 3 == 0 else f"w{i % 50}", None if i % 11 == 0 else i % 13)
        for i in range(3000)
    ]
    return rows


def brute_top(rows, n, key):
    # an entry without quality is of a dictionary without votes, which stays whole
    groups = defaultdict(list)
    for row in rows:
        if row[2] is not None:
            groups[row[1]].append(row)
    best = [r[0] for g in groups.values() for r in sorted(g, key=key)[:n]]
    return sorted(best + [r[0] for r in rows if r[2] is None])


INPUT = lambda r: r[0]
QUALITY = lambda r: (-r[2], r[0])


@pytest.mark.parametrize("by, key", [("input", INPUT), ("quality", QUALITY)])
@pytest.mark.parametrize("limit", [1000, 2])
def test_top_n_both_ways(spark, skewed, by, key, limit, monkeypatch):
    # below Spark's bound by a ranked window, above it by ranges
    monkeypatch.setattr(selection, "_PRUNED_RANKS", limit)
    out = top_n_per_word(frame(spark, skewed), 5, by)
    assert sorted(r["id"] for r in out.collect()) == brute_top(skewed, 5, key)
    assert out.columns == ["id", "word", "quality"]


def test_top_n_larger_than_the_group(spark, skewed):
    out = top_n_per_word(frame(spark, skewed), 5000)
    assert out.count() == 3000


def test_top_n_is_per_dictionary_and_needs_quality(spark):
    rows = [(1, "d0", "a", 1), (2, "d1", "a", 1), (3, "d0", "a", 1)]
    df = frame(spark, rows, "id bigint, dictionary string, word string, quality int")
    assert sorted(r["id"] for r in top_n_per_word(df, 1).collect()) == [1, 2]
    assert top_n_per_word(df.drop("quality"), 1).count() == 3
    with pytest.raises(ValueError):
        top_n_per_word(df, 1, by="luck")


def test_top_n_prunes_before_the_shuffle(spark, skewed):
    plan = top_n_per_word(frame(spark, skewed), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_quality_threshold_is_inclusive(spark):
    df = frame(spark, [(1, "a", 1), (2, "a", 2), (3, "a", None)])
    assert [r["id"] for r in selection.with_quality_at_least(df, 2).collect()] == [2, 3]
    assert selection.with_quality_at_least(df.drop("quality"), 2).count() == 3


def test_best_quality(spark, skewed):
    best = selection.best_quality(frame(spark, skewed)).collect()
    top = defaultdict(lambda: -1)
    for _, word, quality in skewed:
        top[word] = max(top[word], -1 if quality is None else quality)
    assert {r["word"]: r["quality"] for r in best} == dict(top)
    assert len(best) == len(top)


def test_best_quality_ties_follow_the_seed(spark):
    df = frame(spark, [(i, "a", 5) for i in range(20)])
    seeded = min(range(20), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
    assert selection.best_quality(df, seed=3).first()["id"] == seeded
    no_quality = selection.best_quality(df.drop("quality"), seed=3)
    assert no_quality.first()["id"] == seeded and no_quality.count() == 1


def scored(spark):
    rows = [(1, "a", "x", 0.9), (2, "a", "y", 0.5), (3, "b", "x", 0.4), (4, "b", "z", 0.4)]
    return spark.createDataFrame(rows, "id bigint, word string, label_out string, prob_out double")


def test_one_label_per_word(spark):
    last = {r["word"]: r["label_out"] for r in selection.last_wins(scored(spark)).collect()}
    assert last == {"a": "y", "b": "z"}
    best = {r["word"]: r["label_out"] for r in selection.best_wins(scored(spark)).collect()}
    assert best == {"a": "x", "b": "x"}
    assert [r["id"] for r in selection.by_confidence(scored(spark)).collect()] == [1, 2, 3, 4]


def test_confidence_and_report_view(spark):
    assert selection.with_confidence_at_least(scored(spark), 0.5).count() == 2
    rows = [(1, None, 1), (2, "x", 1), (3, None, 0), (4, None, -1)]
    df = spark.createDataFrame(rows, "id bigint, label string, quality int")
    assert [r["id"] for r in selection.unlabelled_positive(df).collect()] == [1]
    assert selection.unlabelled_positive(df.drop("quality")).count() == 3


def test_shuffle_is_a_permutation_of_all_rows(spark):
    df = frame(spark, [(i, "a", 0) for i in range(50)])
    order = [r["id"] for r in selection.seeded_shuffle(df, seed=1).collect()]
    assert order == sorted(range(50), key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest())


@pytest.mark.parametrize("quota", [0, 1, 7, 299, 300, 10_000])
def test_pick_by_quota(spark, quota):
    words = [(f"w{i}", "big" if i % 10 else "small") for i in range(333)]
    terms = spark.createDataFrame(words, "word string, label string")
    quotas = spark.createDataFrame([("big", quota), ("small", 3)], "label string, quota bigint")
    picked = pick_by_quota(terms, quotas, seed=5).collect()
    for label, wanted in (("big", quota), ("small", 3)):
        have = sorted(
            (w for w, l in words if l == label), key=lambda w: hashlib.md5(f"5:{w}".encode()).hexdigest()
        )
        assert sorted(r["word"] for r in picked if r["label"] == label) == sorted(have[:wanted])


def test_first_in_group_with_few_ranges(spark):
    rows = [(i, "a" if i < 70 else "b", 10 if i < 70 else 4) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, g string, n bigint")
    out = first_in_group(df, ["g"], F.floor(F.col("id") / 30), [F.asc("id")], "n")
    assert sorted(r["id"] for r in out.collect()) == [*range(10), *range(70, 74)]

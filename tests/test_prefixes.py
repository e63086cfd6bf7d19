import random

import pytest

from termtide.operators import prefixes
from termtide.operators.labelling import label_prefix
from termtide.operators.prefixes import match_by_sweep, range_bounds


def truth(words, stems):
    out = {}
    for word in words:
        whole = [labels for stem, is_prefix, labels in stems if not is_prefix and stem == word]
        begun = sorted((len(stem), labels) for stem, is_prefix, labels in stems if is_prefix and word.startswith(stem))
        if whole or begun:
            out[word] = whole[0] if whole else begun[-1][1]
    return out


def run(spark, words, stems, ranges):
    w = spark.createDataFrame([(x,) for x in words], "word string")
    s = spark.createDataFrame(stems, "stem string, is_prefix boolean, labels array<string>")
    found = match_by_sweep(w, s, ranges).collect()
    assert len(found) == len({r.word for r in found})
    return {r.word: r.labels for r in found}


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_against_comparing_all(spark, ranges):
    rng = random.Random(ranges)
    letters = "abé\U0001f642�"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(8))) for _ in range(900)}
    stems = {}
    for _ in range(150):
        stem = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
        is_prefix = rng.random() < 0.6
        stems[stem, is_prefix] = (stem, is_prefix, [f"{stem}{is_prefix}", "x"])
    want = truth(words, stems.values())
    assert len(want) > 100
    assert run(spark, words, list(stems.values()), ranges) == want


def test_prefixes_over_range_bounds(spark):
    words = [f"a{i:04d}" for i in range(2000)]
    stems = [("a", True, ["outer"]), ("a01", True, ["inner"]), ("a0150", False, ["whole"]), ("", True, ["all"]), ("zz", True, ["none"])]
    got = run(spark, [*words, "b"], stems, 16)
    assert got["b"] == ["all"] and got["a0000"] == ["outer"] and got["a1999"] == ["outer"]
    assert got["a0150"] == ["whole"] and sum(v == ["inner"] for v in got.values()) == 99


def test_a_hot_first_letter_is_split(spark):
    words = spark.range(30_000).selectExpr("concat('a', lpad(id, 6, '0')) as word").unionByName(
        spark.range(300).selectExpr("concat('z', id) as word")
    )
    bounds = range_bounds(words, 20)
    assert len(bounds) == 19
    cuts = [sum(bounds_of <= f"a{i:06d}".encode() for bounds_of in bounds) for i in range(0, 30_000, 10)]
    sizes = [cuts.count(c) for c in set(cuts)]
    assert len(sizes) >= 18 and max(sizes) < 3 * 3000 / 20


def test_empty_sides(spark):
    assert run(spark, [], [("a", True, ["x"])], 4) == {}
    assert run(spark, ["a"], [], 4) == {}


def test_words_are_shuffled_once(spark, tmp_path):
    entries = spark.range(4000).selectExpr("id", "case when id = 1 then null else concat('W', id % 900) end as word")
    patterns = spark.createDataFrame(
        [("w1*", True, "one", 0, 0), ("w12", False, "whole", 1, 0), ("w12", False, "later", 2, 0)],
        "pattern string, is_prefix boolean, label string, line bigint, ord bigint",
    )
    got = {r.id: r.labels for r in label_prefix(entries, patterns).collect()}
    assert got[12] == ["later"] and got[13] == ["one"] and got[2] == [] and got[1] == [] and len(got) == 4000
    words = prefixes.distinct_words(entries)
    stems = spark.createDataFrame([("w1", True, ["one"])], "stem string, is_prefix boolean, labels array<string>")
    plan = match_by_sweep(words, stems, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("REPARTITION_BY_NUM") in (1, 2) and "Join" not in plan

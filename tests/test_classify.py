import math
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from termtide.operators import classify
from termtide.operators.classify import NaiveBayes, apply_naive_bayes, label_index, train_naive_bayes

TRAIN = [
    ("d0", 1, "animal", "a small dog that barks"),
    ("d0", 2, "animal", "a cat, the small pet"),
    ("d0", 3, "food", "a sweet cake to eat, eat"),
    ("d1", 4, "food", "the cake"),
    ("d1", 5, "animal", "the dog"),
]
TEXTS = [
    ("d0", 10, "small dog"),
    ("d0", 11, "Eat the CAKE unknownword"),
    ("d0", 12, ""),
    ("d0", 13, None),
    ("d1", 14, "dog dog cake"),
    ("d1", 15, "cat"),
]


def words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def brute(train, dictionary, text, labels):
    rows = [(label, words(t)) for d, _, label, t in train if d == dictionary]
    vocabulary = {w for _, ws in rows for w in ws}
    scores = []
    for label in labels:
        own = [ws for l, ws in rows if l == label]
        if not own:
            scores.append(-math.inf)
            continue
        counts = Counter(w for ws in own for w in ws)
        total = sum(counts.values()) + len(vocabulary)
        score = math.log(len(own) / len(rows))
        score += sum(math.log((counts[w] + 1) / total) for w in words(text) if w in vocabulary)
        scores.append(score)
    top = max(scores)
    return labels[scores.index(top)], 1 / sum(math.exp(s - top) for s in scores)


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "dictionary string, id bigint, label string, text string")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.createDataFrame(TEXTS, "dictionary string, id bigint, text string")
    return rows.withColumn("word", F.concat(F.lit("w"), F.col("id")))


@pytest.mark.parametrize("frequent", [8192, 4])
def test_naive_bayes(spark, train, texts, frequent, monkeypatch):
    # with few frequent words the rest goes through the shuffled join
    monkeypatch.setattr(classify, "FREQUENT_WORDS", frequent)
    labels = ["animal", "food", "never"]
    model = train_naive_bayes(train, labels)
    out = {r["id"]: r for r in apply_naive_bayes(texts, model, ["word"]).collect()}
    assert set(out) == {t[1] for t in TEXTS}
    for dictionary, i, text in TEXTS:
        label, prob = brute(TRAIN, dictionary, text, labels)
        assert out[i]["label_out"] == label and out[i]["word"] == f"w{i}"
        assert out[i]["prob_out"] == pytest.approx(prob)


def test_naive_bayes_save_and_load(spark, train, texts, tmp_path):
    model = train_naive_bayes(train, ["animal", "food"])
    path = str(tmp_path / "model")
    model.save(path)
    loaded = NaiveBayes.load(spark, path)
    assert loaded.labels == ["animal", "food"]
    expected = apply_naive_bayes(texts, model).orderBy("id").collect()
    assert apply_naive_bayes(texts, loaded).orderBy("id").collect() == expected
    with pytest.raises(Exception, match="(?i)exists"):
        model.save(path)


def test_label_index(spark, train):
    other = spark.createDataFrame([("zoo",), ("animal",)], "label string")
    rows = label_index(train, other).orderBy("idx").collect()
    assert [(r["idx"], r["label"]) for r in rows] == [(0, "animal"), (1, "food"), (2, "zoo")]


def test_logistic(spark, train, texts, tmp_path):
    model = classify.train_logistic(train, buckets=1 << 10)
    scored = classify.apply_logistic(texts, model)
    out = {r["id"]: r for r in scored.collect()}
    assert scored.columns == [*texts.columns, "label_out", "prob_out"]
    assert out[10]["label_out"] == "animal" and out[11]["label_out"] == "food"
    assert all(0.5 <= r["prob_out"] <= 1 for r in out.values()) and len(out) == len(TEXTS)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    path = str(tmp_path / "logistic")
    model.save(path)
    again = classify.apply_logistic(texts, type(model).load(path))
    assert {r["id"]: r["label_out"] for r in again.collect()} == {i: r["label_out"] for i, r in out.items()}


def test_encode_text(spark, texts):
    rows = classify.encode_text(texts, buckets=64).collect()
    sums = {r["id"]: float(r["features"].toArray().sum()) for r in rows}
    assert sums[10] == 2 and sums[12] == 0 and sums[14] == 3


def test_own_model(spark, texts):
    def load():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            even = batch["id"] % 2 == 0
            return pd.DataFrame({"label_out": even.map({True: "even", False: "odd"}), "prob_out": 0.75})

        return model

    rows = classify.apply_function(texts, load).collect()
    assert {r["id"]: r["label_out"] for r in rows}[11] == "odd"
    assert all(r["prob_out"] == 0.75 for r in rows) and len(rows) == len(TEXTS)


def test_predictor_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

        def predict(texts, sizes):
            return {"label_out": ["long" if len(t) > n else "short" for t, n in zip(texts, sizes)], "prob_out": sizes / 10.0}

        return predict

    rows = spark.range(400).select("id", F.concat(F.lit("t"), F.col("id")).alias("text"), (F.col("id") % 5).alias("n"), F.lit(1).alias("prob_out"))
    out = classify.apply_predictor(rows.repartition(24), make, ["text", "n"], batch_size=7)
    got = {r.id: (r.label_out, r.prob_out) for r in out.collect()}
    assert got == {i: ("long" if len(f"t{i}") > i % 5 else "short", i % 5 / 10) for i in range(400)}
    assert out.columns == ["id", "text", "n", "label_out", "prob_out"]
    loaded = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loaded) == len(set(loaded)) <= 4


def test_a_bad_batch_is_named(spark):
    def make():
        def predict(texts):
            if any(t == "t13" for t in texts):
                raise ValueError("no such text")
            return {"label_out": ["x"] * len(texts), "prob_out": [1.0] * len(texts)}

        return predict

    rows = spark.range(0, 20, 1, 1).select("id", F.concat(F.lit("t"), F.col("id")).alias("text"))
    with pytest.raises(Exception, match="batch of entries 10 to 14: no such text"):
        classify.apply_predictor(rows, make, batch_size=5).collect()
    with pytest.raises(Exception, match="batch of entries 0 to 4: 5 entries, but"):
        classify.apply_predictor(rows, lambda: lambda t: {"label_out": ["x"], "prob_out": [1.0]}, batch_size=5).collect()


def test_regression_in_a_session_that_has_observed(spark, train, texts, tmp_path):
    from termtide.sources.observed import write_observed

    assert write_observed(texts, str(tmp_path / "seen")) == {"rows": len(TEXTS)}
    model = classify.train_logistic(train, buckets=1 << 10)
    assert classify.apply_logistic(texts, model).count() == len(TEXTS)
    assert classify.apply_logistic(texts, model).collect()[0]["label_out"] == "animal"


def test_own_model_is_given_bounded_batches(spark):
    def load():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            held = batch["text"].str.len().sum()
            return pd.DataFrame({"label_out": [str(held)] * len(batch), "prob_out": [None, *[0.5] * (len(batch) - 1)]})

        return model

    rows = spark.range(3000).select("id", F.expr("repeat('x', 4000)").alias("text"), F.expr("timestamp_seconds(id)").alias("at"))
    out = classify.apply_function(rows.coalesce(1), load)
    found = out.select("id", "at", "label_out", "prob_out", F.length("text").alias("n")).collect()
    assert sorted(r.id for r in found) == list(range(3000)) and {r.n for r in found} == {4000}
    assert all(r["at"].timestamp() == r["id"] for r in found)
    assert max(int(r.label_out) for r in found) <= classify.BATCH_BYTES
    assert {r.prob_out for r in found} == {None, 0.5}


def test_model_within_the_bound_needs_one_pass(spark, train, texts, tmp_path):
    train_naive_bayes(train, ["animal", "food"]).save(str(tmp_path / "model"))
    model = NaiveBayes.load(spark, str(tmp_path / "model"))
    others = texts.withColumn("dictionary", F.lit("untrained")).limit(3)
    scored = apply_naive_bayes(texts.unionByName(others).localCheckpoint(), model, ["word"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan
    rows = scored.collect()
    untrained = [r for r in rows if r["dictionary"] == "untrained"]
    assert len(rows) == len(TEXTS) + 3 and len(untrained) == 3
    assert all(r["label_out"] is None and r["prob_out"] is None for r in untrained)

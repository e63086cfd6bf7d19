import pytest

from termtide.operators import metrics

PERFECT = [("north", "north", 0.2), ("east", "east", 0.3), ("south", "south", 0.6), ("west", "west", 0.8)]
HALF = [("north", "north", 0.3), ("east", "south", 0.55), ("south", "south", 0.75), ("west", "north", 0.95)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "label string, label_out string, prob_out double")


@pytest.mark.parametrize(
    "rows, threshold, precision, coverage",
    [
        (PERFECT, 0, 1, 1),
        (PERFECT, 0.5, 1, 0.5),
        (PERFECT, 1, 0, 0),
        (HALF, 0, 0.5, 1),
        (HALF, 0.5, 1 / 3, 0.75),
    ],
)
def test_precision_at(spark, rows, threshold, precision, coverage):
    row = metrics.precision_at(frame(spark, rows), threshold).first()
    assert row["precision"] == pytest.approx(precision)
    assert row["coverage"] == pytest.approx(coverage)


def test_curve(spark):
    curve = {r["threshold"]: r for r in metrics.threshold_curve(frame(spark, PERFECT)).collect()}
    assert len(curve) == 101 and min(curve) == 0 and max(curve) == 1
    assert [(curve[t]["precision"], curve[t]["coverage"]) for t in (0, 0.5, 1)] == [(1, 1), (1, 0.5), (0, 0)]


def test_curves_equal_a_scan_per_point(spark):
    edges = [i * 0.01 for i in range(101)] + [i / 100 for i in range(101)] + [0.2899999, 0.999999, 1.0000001]
    rows = [("a", "a" if i % 3 else "b", p) for i, p in enumerate(edges)] + [("a", "a", None), ("a", "a", -0.5)]
    df = frame(spark, rows)
    curve = sorted(metrics.threshold_curve(df).collect(), key=lambda r: r["threshold"])
    counts = sorted(metrics.count_curve(df).collect(), key=lambda r: r["threshold"])
    for t in range(101):
        kept = [r for r in rows if r[2] is not None and r[2] >= t * 0.01]
        right = [r for r in kept if r[0] == r[1]]
        assert counts[t]["n"] == len(kept), t
        assert curve[t]["precision"] == pytest.approx(len(right) / len(kept) if kept else 0)
        assert curve[t]["coverage"] == pytest.approx(len(kept) / len(rows))


def test_curve_per_dictionary_and_empty(spark):
    df = spark.createDataFrame(
        [("d0", "a", "a", 0.3), ("d1", "a", "b", 0.6)],
        "dictionary string, label string, label_out string, prob_out double",
    )
    rows = metrics.count_curve(df, ["dictionary"]).collect()
    assert len(rows) == 202
    assert {(r["dictionary"], r["n"]) for r in rows if r["threshold"] == 0.5} == {("d0", 0), ("d1", 1)}
    assert metrics.threshold_curve(df.filter("false")).count() == 101


def test_curve_reads_the_scores_once(spark, tmp_path):
    path = str(tmp_path / "scores")
    frame(spark, HALF).write.parquet(path)
    stored = spark.read.parquet(path)
    for out in (metrics.threshold_curve(stored), metrics.class_report(stored)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1


def test_report(spark):
    rows = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), ("d", "a")]
    df = frame(spark, [(t, p, 1.0) for t, p in rows])
    listed = spark.createDataFrame([("e",), ("a",)], "label string")
    report = {r["label"]: r for r in metrics.class_report(df, listed).collect()}
    assert set(report) == {"a", "b", "c", "d", "e", "macro avg", "weighted avg"}

    def of(label):
        r = report[label]
        return pytest.approx((r["precision"], r["recall"], r["f1"])), r["support"]

    assert of("a") == ((2 / 3, 2 / 3, 2 / 3), 3)
    assert of("b") == ((0.5, 0.5, 0.5), 2)
    assert of("c") == ((0, 0, 0), 0)
    assert of("d") == ((0, 0, 0), 1)
    assert of("e") == ((0, 0, 0), 0)
    assert of("macro avg") == (((2 / 3 + 0.5) / 5,) * 3, 6)
    assert of("weighted avg") == (((2 + 1) / 6,) * 3, 6)
    # the mean f1 is over labels seen only
    assert metrics.macro_f1(df).first()["macro_f1"] == pytest.approx((2 / 3 + 0.5) / 4)
    assert metrics.accuracy(df).first()["accuracy"] == pytest.approx(0.5)


def test_value_counts(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "label string")
    assert [tuple(r) for r in metrics.value_counts(df).collect()] == [("a", 1), ("b", 2), ("c", 1)]
    assert [tuple(r) for r in metrics.value_counts(df, by_count=True).collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_distribution(spark):
    df = spark.createDataFrame(
        [("d0", "a"), ("d0", "a"), ("d1", "b"), ("d1", "a")], "dictionary string, label string"
    )
    rows = {r["label"]: (r["n"], r["share"]) for r in metrics.label_distribution(df).collect()}
    assert rows == {"a": (3, 0.75), "b": (1, 0.25)}
    assert metrics.average_size(df).first()[0] == 2.0
    assert metrics.average_size(df, n_dictionaries=4).first()[0] == 1.0

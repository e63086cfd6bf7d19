import threading

import pytest
from pyspark.sql import functions as F

from termtide.sources import observed, tables
from termtide.sources.answer_log import AnswerLog
from termtide.sources.files import create_once, names_in, read_text


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value string")


def content(log, number=None):
    return {r.key: r.value for r in log.snapshot(number).collect()}


def test_later_commit_wins_and_snapshots_stay(spark, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "log"))
    assert content(log) == {} and log.latest() == 0 and log.compact() == 0
    assert log.append(rows(spark, [("a", "z"), ("b", "1")])) == 1
    assert log.append(rows(spark, [("a", "c"), ("a", "b"), ("n", None)])) == 2
    assert content(log) == {"a": "c", "b": "1", "n": None}
    assert content(log, 1) == {"a": "z", "b": "1"}
    assert [c.rows for c in log.commits()] == [2, 3]


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    parts = [rows(spark, [(f"own{i}", str(i)), ("shared", str(i))]) for i in range(8)]
    numbers, start = {}, threading.Barrier(8)

    def write(i):
        start.wait()
        numbers[i] = AnswerLog(spark, path).append(parts[i])

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers.values()) == list(range(1, 9))
    found = content(AnswerLog(spark, path))
    assert {k: v for k, v in found.items() if k != "shared"} == {f"own{i}": str(i) for i in range(8)}
    assert found["shared"] == str(max(numbers, key=numbers.get))


def test_claims(spark, tmp_path):
    path = str(tmp_path / "x" / "1.json")
    assert create_once(spark, path, "one") and not create_once(spark, path, "two")
    assert read_text(spark, path) == "one" and names_in(spark, str(tmp_path / "x")) == ["1.json"]
    assert names_in(spark, str(tmp_path / "none")) == []


def test_compaction(spark, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "log"))
    for i in range(4):
        log.append(rows(spark, [("k", str(i)), (f"k{i}", "x")]))
    before = content(log)
    # an append that comes between reading and committing stays the later one
    slow = AnswerLog(spark, log.path)
    write = slow._write

    def late(df):
        out = write(df)
        log.append(rows(spark, [("k", "late")]))
        return out

    slow._write = late
    assert slow.compact() == 6
    assert content(log) == {**before, "k": "late"}
    assert content(log, 4) == before and content(log, 3)["k"] == "2"
    plan = log.snapshot()._jdf.queryExecution().analyzed().toString()
    assert log.compact() == 7
    log.append(rows(spark, [("k1", "y")]))
    assert content(log) == {**before, "k": "late", "k1": "y"}
    assert len(log.snapshot().inputFiles()) < 20 and plan


def test_manifests_come_from_the_pass_that_writes(spark, tmp_path):
    entries = spark.createDataFrame(
        [(1, "a", "x", "l1"), (2, "b", None, "l2"), (3, "b", "y", "l1")], "id bigint, word string, text string, label string"
    )
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    df = entries.mapInArrow(counted, entries.schema)
    tables.write_dictionary(df, str(tmp_path / "d"), conf={"name": "d"})
    assert passes.value == 3
    facts = observed.manifest_of(spark, str(tmp_path / "d"))
    assert facts["counts"] == {"rows": 3, "without_text": 1} and facts["conf"] == {"name": "d"}
    assert facts["path"] == str(tmp_path / "d") and facts["columns"] == ["id", "word", "text", "label"]
    tables.write_dataset(str(tmp_path / "s"), entries.filter("id < 3"), entries.filter("id = 3"), conf={"seed": 0})
    assert observed.manifest_of(spark, str(tmp_path / "s"))["counts"] == {"train": 2, "test": 1, "labels": ["l1", "l2"]}
    assert tables.read_dataset(spark, str(tmp_path / "s"), "train").count() == 2
    observed.add_results(spark, str(tmp_path / "s"), {"accuracy": 0.5})
    assert observed.manifest_of(spark, str(tmp_path / "s"))["results"] == {"accuracy": 0.5}
    grown = spark.createDataFrame([("t", "l1", 0.9)], "term string, label string, prob_out double")
    tables.write_expanded(grown.filter(F.lit(False)), str(tmp_path / "e"))
    assert observed.manifest_of(spark, str(tmp_path / "e"))["counts"] == {"terms": 0, "labels": []}
    with pytest.raises(observed.NoManifestError):
        observed.manifest_of(spark, str(tmp_path / "nothing"))

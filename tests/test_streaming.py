import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termtide.plans.dataset import EntryRules, valid_entries
from termtide.queries import catalog
from termtide.streaming.labelling import valid_entries_stream

SCHEMA = "dictionary string, id bigint, word string, text string, quality int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = ["run", "Run", "walk", "stop", "unknown", "sky"]
    rows = [(f"d{i % 2}", i, "run" if i % 3 == 0 else rng.choice(words), f"t{i}", rng.randrange(5)) for i in range(300)]
    lexicon = spark.createDataFrame(
        [("run", "b", 2), ("run", "a", 1), ("walk", "a", 3), ("stop", "c", 4), ("sky", "b", 5)], "word string, label string, ord bigint"
    )
    return rows, lexicon, spark.createDataFrame([("STOP",)], "term string")


def feed(spark, folder, checkpoint, out, lexicon, exclusions, rules):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    valid = valid_entries_stream(stream, lexicon, exclusions, rules)
    query = valid.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


@pytest.mark.parametrize("rules", [EntryRules(top_n=7, quality_threshold=2), EntryRules(quality_threshold=1), EntryRules(top_n=1)])
def test_micro_batches_and_a_restart_give_the_batch(spark, tables, tmp_path, rules):
    rows, lexicon, excluded = tables
    folder, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    for part in range(3):
        chunk = rows[part * 60 : part * 60 + 60]
        random.Random(part).shuffle(chunk)
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    feed(spark, folder, checkpoint, out, lexicon, [excluded], rules)
    before = spark.read.parquet(out).count()
    spark.createDataFrame(rows[180:], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    feed(spark, folder, checkpoint, out, lexicon, [excluded], rules)
    whole = valid_entries(spark.createDataFrame(rows, SCHEMA), lexicon, [excluded], rules)
    columns = sorted(whole.columns)
    found = spark.read.parquet(out)
    assert found.count() >= before > 0
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    # nothing new: nothing more
    feed(spark, folder, checkpoint, out, lexicon, [excluded], rules)
    assert spark.read.parquet(out).count() == found.count()


def test_best_of_a_stream_is_refused(spark, tables):
    stream = spark.readStream.format("rate").load().select(
        F.lit("d").alias("dictionary"), F.col("value").alias("id"), F.lit("run").alias("word"), F.lit("").alias("text"), F.lit(1).alias("quality")
    )
    with pytest.raises(ValueError, match="first"):
        valid_entries_stream(stream, tables[1], [], EntryRules(top_n=1, top_by="quality"))


def test_arriving_files_are_written_by_many_tasks(spark, monkeypatch):
    made, real = {}, catalog.scratch_path
    monkeypatch.setattr(catalog, "scratch_path", lambda session, label: made.setdefault(label, real(session, label)))
    found = catalog.QUERIES["job_valid_entries_stream"](spark, "/root/testdata/sf0.001")
    folder = Path(made["arriving"].removeprefix("file:"))
    assert len(list(folder.glob("part-*.parquet"))) > 3
    assert len(list(Path(made["stream-state"].removeprefix("file:")).glob("commits/[0-9]*"))) == 3
    whole = catalog.QUERIES["job_valid_entries"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))

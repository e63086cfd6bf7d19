import pytest
from pyspark.sql import functions as F

from termtide.operators.labelling import label_exact
from termtide.operators.splitting import test_entries as entries_of_terms
from termtide.operators.splitting import train_entries
from termtide.sources.bucketed import NotBucketedError, label_bucketed, read_bucketed, split_bucketed, table_name, write_bucketed


@pytest.fixture
def entries(spark):
    word = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("w"), F.col("id") % 97))
    return spark.range(1500).select("id", word.alias("word"), F.concat(F.lit("t"), F.col("id")).alias("text"))


def rows(df):
    return sorted(map(repr, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_leave_the_buckets_as_they_lie(spark, entries, tmp_path, no_broadcast):
    path = str(tmp_path / "entries")
    table = write_bucketed(entries, path, 6)
    assert rows(table) == rows(entries)
    terms = spark.range(0, 97, 5).select(F.concat(F.lit("w"), "id").alias("word"), F.lit("l").alias("label"))
    lexicon = spark.range(0, 97, 3).select(F.concat(F.lit("w"), "id").alias("word"), F.lit("l").alias("label"), F.col("id").alias("ord"))
    test, train = split_bucketed(table, terms)
    labelled = label_bucketed(table, lexicon)
    assert rows(test) == rows(entries_of_terms(entries, terms)) and rows(train) == rows(train_entries(entries, terms))
    assert rows(labelled) == rows(label_exact(entries, lexicon))
    for df in (test, train, labelled):
        plan = plan_of(df)
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        # the branch of the entries, from the join to the scan
        branch = plan[plan.index("Join") :]
        own = branch[: branch.index("Scan parquet")]
        assert "Bucketed: true" in plan and "Exchange" not in own, plan


def test_other_sessions_read_the_buckets(spark, entries, tmp_path):
    path = str(tmp_path / "entries")
    write_bucketed(entries, path, 4)
    other = spark.newSession()
    spark.sql(f"DROP TABLE {table_name(path)}")
    again = read_bucketed(other, path)
    counted = plan_of(again.groupBy("word").count())
    assert rows(again) == rows(entries) and "Bucketed: true" in counted and "Exchange" not in counted
    assert len({f for f in again.inputFiles()}) <= 4
    with pytest.raises(FileExistsError):
        write_bucketed(entries, path, 4)
    write_bucketed(entries.filter("id < 5"), path, 2, overwrite=True)
    assert read_bucketed(spark, path).count() == 5
    with pytest.raises(NotBucketedError):
        read_bucketed(spark, str(tmp_path / "none"))

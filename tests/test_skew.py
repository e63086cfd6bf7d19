"""A word that holds a third of all rows is split among tasks."""

import pytest
from pyspark.sql import functions as F

from termtide.operators import labelling, selection

# Makes adaptive execution take small partitions for large ones.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    # splitting has to work without being forced
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def entries(spark):
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 997))
    return spark.range(0, 60_000, 1, 8).select(
        "id", hot.alias("word"), F.sha2(F.col("id").cast("string"), 256).alias("text"), (F.col("id") % 7).alias("quality")
    )


@pytest.fixture
def lexicon(entries):
    words = entries.select("word").distinct()
    return words.select("word", F.concat(F.lit("l"), F.length("word")).alias("label"), F.lit(0).cast("bigint").alias("ord"))


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hot_word_is_split_in_lookups(spark, small_partitions, entries, lexicon):
    for joined, rows in (
        (labelling.label_exact(entries, lexicon), 60_000),
        (labelling.label_first(entries, lexicon), 60_000),
        (labelling.new_terms(entries, lexicon.filter("word <> 'hot'")), 20_000),
        (labelling.drop_exclusions(entries, lexicon.filter("word <> 'hot'").select(F.col("word").alias("term"))), 20_000),
    ):
        assert len(joined.collect()) == rows
        assert "skew=true" in final_plan(joined)


def test_window_after_a_lookup_prunes_first(spark, small_partitions, entries, lexicon):
    labelled = labelling.label_first(entries, lexicon)
    top = selection.top_n_per_word(labelled, 3)
    assert len(top.collect()) == 3 * entries.select("word").distinct().count()
    plan = final_plan(top)
    assert "skew=true" in plan
    assert plan.count("WindowGroupLimit") == 2

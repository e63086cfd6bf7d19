import json

import pytest

from termtide.operators.labelling import label_lists
from termtide.session import shared_dir, stage
from termtide.sources import tables
from termtide.sources.dictionaries import read_dictionary_csv
from termtide.sources.lexicons import read_lexicon_csv

ROWS = [(1, "a", 'x, "y"', "l"), (2, "b", "", "m"), (3, "c", "  z ", "l")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id bigint, word string, text string, label string")


@pytest.mark.parametrize("with_valid", [False, True])
def test_dataset_round_trip(spark, rows, tmp_path, with_valid):
    path = str(tmp_path / "set")
    valid = rows.filter("id = 2") if with_valid else None
    tables.write_dataset(path, rows.filter("id = 1"), rows.filter("id = 3"), valid)
    assert [tuple(r) for r in tables.read_dataset(spark, path, "train").collect()] == [ROWS[0]]
    assert [tuple(r) for r in tables.read_dataset(spark, path, "test").collect()] == [ROWS[2]]
    assert tables.read_dataset(spark, path).count() == 2 + with_valid
    assert tables.read_dataset(spark, path, "valid").count() == with_valid


def test_dataset_errors(spark, rows, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(tables.DatasetNotFoundError):
        tables.read_dataset(spark, path)
    tables.write_dataset(path, rows, rows)
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_dataset(path, rows, rows)
    tables.write_dataset(path, rows.limit(1), rows.limit(1), overwrite=True)
    assert tables.read_dataset(spark, path).count() == 2


def test_split_is_pruned(spark, rows, tmp_path):
    path = str(tmp_path / "set")
    tables.write_dataset(path, rows, rows)
    plan = tables.read_dataset(spark, path, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_dictionary_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "d")
    tables.write_dictionary(rows.drop("label"), path)
    back = read_dictionary_csv(spark, path, "id bigint, word string, text string").orderBy("id")
    assert [tuple(r) for r in back.collect()] == [r[:3] for r in ROWS]


def test_scored_round_trip(spark, tmp_path):
    path = str(tmp_path / "s")
    scored = spark.createDataFrame([(1, "7", 0.5), (2, "d1", 0.25)], "id bigint, dictionary string, prob_out double")
    tables.write_scored(scored, path)
    assert [r["id"] for r in tables.read_scored(spark, path, "7").collect()] == [1]
    assert dict(tables.read_scored(spark, path).dtypes)["dictionary"] == "string"


def test_expanded_round_trip(spark, tmp_path):
    path = str(tmp_path / "e")
    grown = spark.createDataFrame([("play", "verb"), ("a, b", "noun")], "term string, label string")
    tables.write_expanded(grown, path)
    assert sorted(tuple(r) for r in tables.read_expanded(spark, path).collect()) == [("a, b", "noun"), ("play", "verb")]
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_expanded(grown, path)
    plain = str(tmp_path / "p")
    tables.write_expanded(grown.filter("term = 'play'"), plain)
    lists = label_lists(read_lexicon_csv(spark, plain)).collect()
    assert [(r["word"], list(r["labels"])) for r in lists] == [("play", ["verb"])]


def test_manifest(spark, rows, tmp_path):
    counts = rows.selectExpr("count(*) AS n", "count(DISTINCT label) AS labels")
    path = str(tmp_path / "m")
    tables.write_manifest(tables.manifest({"b": 1, "a": [2]}, counts), path)
    back = tables.read_manifest(spark, path)
    assert (back["n"], back["labels"], json.loads(back["conf"])) == (3, 2, {"a": [2], "b": 1})


def test_stage_is_a_table_in_the_shared_folder(spark, rows):
    root = shared_dir(spark)
    assert shared_dir(spark) == root
    stored = stage(rows.filter("id > 1"), "test")
    assert sorted(stored.inputFiles())[0].startswith("file://" + root)
    assert stored.schema == rows.schema and stored.count() == 2

"""Queries against the same query in SQL; all of them with TERMTIDE_ALL_QUERIES=1."""

import math
import os
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

from termtide.queries.catalog import QUERIES  # noqa: E402
from termtide.queries.oracle import ORACLE  # noqa: E402

DATA = Path(os.environ.get("TERMTIDE_TESTDATA", "/root/testdata/sf0.001"))
QUICK = [
    "agg_class_report",
    "agg_test_quota",
    "agg_threshold_curve",
    "anti_exclusions",
    "job_expand_lexicon",
    "job_ask_labels",
    "job_split_dataset",
    "job_valid_entries_mixed",
    "join_bucketed",
    "join_label_prefix",
    "join_lookup_mapped",
    "ml_apply",
    "ml_apply_softmax",
    "ml_encode_text",
    "ml_train_softmax",
    "sort_permuted",
    "src_dictionary_votes",
    "src_scored",
    "src_lexicon_wide",
    "win_best_quality",
    "xf_prompt_details",
    "xf_softmax_argmax",
    "xf_strict_patterns",
]
ALL = sorted(entry.oracle_sql())
# queries of the optional subpackage have their own tests
OWN = [name for name in ALL if name in ORACLE]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", OWN if os.environ.get("TERMTIDE_ALL_QUERIES") else QUICK)
def test_same_as_sql(spark, sql, name):
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    ours = [tuple(plain(row[c]) for c in names) for row in df.collect()]
    cursor = sql.execute(entry.oracle_sql()[name])
    place = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(place) == names
    theirs = [tuple(plain(row[place[c]]) for c in names) for row in cursor.fetchall()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
    assert ours


def test_lexicon_csv_keeps_repeated_labels(spark, tmp_path):
    # read without case, two languages are one label of two lines
    rows = [(i, lang, "harbour a\nharbour b\nquay c") for i, lang in enumerate(["en", "EN", "fr", "en", "EN"])]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ours = entry.queries()["src_lexicon_csv"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(entry.oracle_sql()["src_lexicon_csv"]).fetchall()
    assert sorted((r["word"], r["labels"]) for r in ours) == [("harbour", "en|en|fr"), ("quay", "en|en")]
    assert sorted((word, labels.lower()) for word, labels in theirs) == [("harbour", "en|en|fr"), ("quay", "en|en")]


def test_every_query_has_sql_but_fitted_models():
    assert set(QUERIES) - set(ALL) == {"ml_apply_logistic"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["dictionary", "label", "n"]

"""Tables kept in buckets by word.

Rows of a word lie in one bucket, sorted by it, so that joins by word take this side as it lies: only the other
side is shuffled, to the same buckets. A word's rows stay together, so tables whose words have a bounded
number of rows are kept this way, as entries after top-n are; for others ``lookup_join`` splits hot words.

A bucketed table is files and a description; the description is kept beside the files, so that any session
reads them as buckets.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termtide.session import path_exists
from termtide.sources.files import read_text, write_text

_DESCRIPTION = "_buckets.json"


class NotBucketedError(FileNotFoundError):
    pass


def table_name(path: str) -> str:
    """What a session calls the table at a path."""
    return f"bucketed_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


def write_bucketed(rows: DataFrame, path: str, buckets: int, by: str = "word", overwrite: bool = False) -> DataFrame:
    """Writes one sorted file per bucket and returns the table. Words are taken as they are, case and all."""
    spark = rows.sparkSession
    if path_exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
    # dealt out as the buckets are, so that each is written by one task
    dealt = rows.repartition(buckets, by)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, by).sortBy(by).saveAsTable(table_name(path))
    facts = {"buckets": buckets, "by": by, "schema": rows.schema.json()}
    write_text(spark, f"{path.rstrip('/')}/{_DESCRIPTION}", json.dumps(facts))
    return spark.table(table_name(path))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_bucketed``, in this or another session."""
    description = f"{path.rstrip('/')}/{_DESCRIPTION}"
    if not path_exists(spark, description):
        raise NotBucketedError(path)
    if not spark.catalog.tableExists(table_name(path)):
        facts = json.loads(read_text(spark, description))
        fields = T.StructType.fromJson(json.loads(facts["schema"])).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE {table_name(path)} ({columns}) USING parquet"
            f" CLUSTERED BY (`{facts['by']}`) SORTED BY (`{facts['by']}`) INTO {facts['buckets']} BUCKETS LOCATION '{path}'"
        )
    return spark.table(table_name(path))


def bucket_join(bucketed: DataFrame, other: DataFrame, how: str, by: str = "word") -> DataFrame:
    """A bucketed table joined by its key: it is not shuffled, ``other`` is, unless it is small enough to broadcast."""
    return bucketed.join(other, by, how)


def label_bucketed(bucketed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entries in buckets of lower-case words with ``labels``, as ``label_exact`` gives them."""
    from termtide.functions.labels import label_array
    from termtide.operators.labelling import label_lists

    lists = lexicon if "labels" in lexicon.columns else label_lists(lexicon)
    joined = bucket_join(bucketed, lists.select("word", "labels"), "left")
    return joined.select(*bucketed.columns, F.coalesce("labels", label_array([])).alias("labels"))


def split_bucketed(bucketed: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of the test terms and those of other words, as ``test_entries`` and ``train_entries`` give them."""
    words = terms.select("word")
    return bucket_join(bucketed, words, "left_semi"), bucket_join(bucketed, words, "left_anti")

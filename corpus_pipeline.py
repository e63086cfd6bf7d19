"""The corpus pipeline: five filters and a packing step, each on what the one before kept.

``STAGES`` lists them as (name, function of ``spark, docs, sf_dir``); all but the last
return the columns of ``documents``. ``run`` applies them to ``documents`` and writes
what each returns, so that a later stage never repeats an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.llm import exact_dedup, minhash, packing, suffix_dedup, toxicity
from termtide.llm.common import free_name, shipped, table
from termtide.session import stage

TOXIC = 0.5  # documents that score as high as this are rejected
VOCABULARY = "word_bpe_49k.json"


def with_own_id(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that numbers rows in the order of ``doc_id``, each row by its own number.

    That is ``doc_id`` itself where each row has one of its own; else the rows are sorted and numbered.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if not shared.head(1):
        return docs, "doc_id"
    name = free_name(docs, "row_number")
    ordered = docs.orderBy(F.asc_nulls_first("doc_id"), "text")
    return stage(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered-rows"), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold, by a lexicon learned from the labelled ones."""
    shipped(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = toxicity.learn(docs.select("doc_id", "text"), labels)
    name = free_name(docs, "toxicity")
    return toxicity.score(docs, lexicon, name).filter(F.col(name) < TOXIC).drop(name)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text but for white space."""
    shipped(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar five-word shingles connect."""
    shipped(spark)
    rows, own = with_own_id(docs)
    return minhash.drop_near_copies(rows, size=5, percent=80, id_col=own).select(*docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that also start earlier.

    A character of which a part goes, goes whole. ``n_chars`` follows the text; a
    document of which nothing is left stays, with an empty text.
    """
    shipped(spark)
    rows, own = with_own_id(docs)
    no_text = free_name(rows, "no_text")
    others = [c for c in docs.columns if c != "text"]
    cut = suffix_dedup.drop_repeats(rows.withColumn(no_text, F.col("text").isNull()), id_col=own, also=[*others, no_text])
    was_cut = F.col("n_removed") > 0
    columns = {c: F.col("also").getField(c) for c in others}
    # what stays of a text that nothing went from is the text
    columns["text"] = F.when(was_cut, F.col("kept_text")).when(~F.col("also").getField(no_text), F.col("kept").cast("string"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(was_cut, F.length("kept_text")).otherwise(columns["n_chars"]).cast("bigint")
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences."""
    shipped(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("suffix dedup", drop_passages),
    ("packing", pack),
]

# The lexicon is learned and the packing goes round by round: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

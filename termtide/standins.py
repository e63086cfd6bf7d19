"""Lexicon, dictionaries and scores derived from the general test tables.

The test tables hold no lexicon and no dictionary, so every line of every
document is taken as an entry of the first word on it, and the language of the
document as that word's label. See ``oracle.py`` for the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termtide.operators.joins import lookup_join
from termtide.session import local_table
from termtide.sources.fixed import hierarchy_table

# Lines per document an id has room for.
LINE_SPAN = 100_000
EXCLUDED_WORDS = 50
LABEL_TREE: dict[str, str | None] = {
    "en": "germanic",
    "de": "germanic",
    "fr": "romance",
    "es": "romance",
    "germanic": "european",
    "romance": "european",
    "european": None,
}
TREE_USED = ["european", "germanic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table read in fewer pieces than there are cores is dealt out to all of them.

    Only a small table is; one of many files stays as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, dictionary, word, text, quality, lang, pos``: one per line that has a word."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lines = spread(documents, "doc_id").select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")
    )
    return lines.select(
        (F.col("doc_id") * LINE_SPAN + F.col("pos")).alias("id"),
        F.concat(F.lit("d"), (F.col("doc_id") % 2).cast("string")).alias("dictionary"),
        F.lower(F.regexp_extract("text", r"(\p{L}+)", 1)).alias("word"),
        "text",
        (F.length("text") % 13 - 2).cast("bigint").alias("quality"),
        "lang",
        F.col("pos").cast("bigint").alias("pos"),
    ).filter("word <> ''")


def plain_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as a dictionary has them."""
    return entries(spark, sf_dir).drop("lang", "pos")


def word_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, lang, n``: entries per word and language."""
    return entries(spark, sf_dir).groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, label, ord``: languages with two or more entries, most frequent first."""
    rank = Window.partitionBy("word").orderBy(F.desc("n"), "lang")  # one row per language
    return (
        word_langs(spark, sf_dir)
        .filter("n >= 2")
        .select("word", F.col("lang").alias("label"), F.row_number().over(rank).cast("bigint").alias("ord"))
    )


def hierarchy(spark: SparkSession) -> DataFrame:
    return hierarchy_table(spark, LABEL_TREE)


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern lexicon: each three-letter beginning of lexicon words as a prefix, with the
    label most of these words have, and every third of the words itself."""
    firsts = lexicon(spark, sf_dir).filter("ord = 1").select("word", "label")
    starts = (
        firsts.filter(F.length("word") >= 3)
        .groupBy(F.substring("word", 1, 3).alias("stem"), "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("stem")
        .agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    )
    prefixes = starts.select(
        F.concat("stem", F.lit("*")).alias("pattern"), F.lit(True).alias("is_prefix"), "label"
    )
    whole = firsts.filter(F.length("word") % 3 == 0).select(
        F.col("word").alias("pattern"), F.lit(False).alias("is_prefix"), "label"
    )
    zero = F.lit(0).cast("bigint")
    return prefixes.unionByName(whole).select("*", zero.alias("line"), zero.alias("ord"))


def frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term``: the words with the most entries."""
    counts = entries(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(EXCLUDED_WORDS)
    return top.select(F.col("word").alias("term"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the language as ``label`` and, as prediction, their word's
    main language with its share."""
    main = word_langs(spark, sf_dir).groupBy("word").agg(
        F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("label_out"),
        (F.max("n") / F.sum("n")).alias("prob_out"),
    )
    known = entries(spark, sf_dir).withColumnRenamed("lang", "label").drop("pos")
    return lookup_join(known, main, ["word"], "inner")


def vote_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as raw vote records: encoded texts, some with stray ``%``, some without votes."""
    blank = F.col("id") % 10 == 0
    encoded = F.replace("text", F.lit(" "), F.when(F.col("id") % 3 == 0, "+").otherwise("%20"))
    stray = F.concat(encoded, F.when(F.col("id") % 7 == 0, "%zz").otherwise(""))
    return entries(spark, sf_dir).select(
        "id",
        F.initcap("word").alias("word"),
        F.replace(stray, F.lit("|"), F.lit("/")).alias("meaning"),
        F.lit("an%20example+here").alias("example"),
        F.when(blank, "").otherwise((F.length("text") % 50).cast("string")).alias("numLikes"),
        (F.col("pos") % 7).cast("string").alias("numDislikes"),
        F.concat(F.lit("#"), F.upper("lang")).alias("tagList"),
    )


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, text`` of all user turns."""
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, text, answer``: user turns with the text that follows."""
    talk = table(spark, sf_dir, "conversations")
    user = talk.filter("role = 'user'").select("conv_id", "turn", "text")
    reply = talk.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return user.join(reply, ["conv_id", "turn"])


FREQUENT_PIECES = 600


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``piece, id``: the special pieces, each character of entry words as a first and a later piece, the most
    frequent entry words, and the most frequent endings of three letters."""
    counted = entries(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    bare = F.col("word").rlike("^[a-z]+$")
    letters = counted.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct()
    singles = letters.select(F.explode(F.array(F.col("c"), F.concat(F.lit("##"), "c"))).alias("piece"))
    words = counted.filter(bare & (F.length("word") > 1)).orderBy(F.desc("n"), "word").limit(FREQUENT_PIECES).select(F.col("word").alias("piece"))
    endings = (
        counted.filter(bare & (F.length("word") > 3))
        .groupBy(F.concat(F.lit("##"), F.expr("right(word, 3)")).alias("piece"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(FREQUENT_PIECES)
        .select("piece")
    )
    given = local_table(spark, {"piece": ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]})
    special = given.withColumn("_part", F.lit(0))
    rest = singles.union(words).union(endings).distinct().withColumn("_part", F.lit(1))
    # a vocabulary has a bounded size, whatever the tables hold
    order = Window.orderBy("_part", F.when(F.col("_part") == 0, F.array_position(F.lit(["[PAD]", "[UNK]", "[CLS]", "[SEP]"]), F.col("piece"))), "piece")
    return special.union(rest).select("piece", (F.row_number().over(order) - 1).cast("int").alias("id"))

"""Text classifiers over dictionary entries.

Two are built in: naive Bayes written as grouped counts and joins, whose model
is a table, and a Spark ML logistic regression on hashed word counts, whose size
does not grow with the vocabulary and which is applied without any shuffle. A
model of one's own is applied batch by batch with ``apply_function``.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, SQLTransformer, StringIndexer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termtide.functions.labels import best_label, best_probability, label_array
from termtide.functions.text import words_of
from termtide.operators.joins import lookup_join

# The pseudo word every text has once; its weights are the class priors.
_PRIOR = ""
# Words frequent in training are joined without a shuffle, by a table of at most this many
# rows and, with many labels, of this many numbers; the rest of the vocabulary is joined by shuffle.
FREQUENT_WORDS = 1 << 20
FREQUENT_NUMBERS = 1 << 22
# What a model of one's own is given at once, besides Spark's bound of rows.
BATCH_BYTES = 1 << 20


def label_index(train: DataFrame, test: DataFrame) -> DataFrame:
    """``label, idx``: the labels of both sets numbered in alphabetical order."""
    labels = train.select("label").union(test.select("label")).distinct()
    ordered = F.array_sort(F.collect_set("label"))  # one row per label
    return labels.agg(ordered.alias("all")).select(F.posexplode("all").alias("idx", "label"))


def token_counts(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``token, n`` per text: the features of the naive Bayes classifier."""
    tokens = entries.select(*keep, F.explode(words_of(F.col("text"))).alias("token"))
    return tokens.groupBy(*keep, "token").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class NaiveBayes:
    """``weights``: ``dictionary, token, n, w ARRAY<DOUBLE>``, aligned with ``labels``.

    One model per dictionary, held in one table. ``n`` is the token's count in training.
    """

    labels: list[str]
    weights: DataFrame

    def save(self, path: str, mode: str = "errorifexists") -> None:
        named = self.weights.withColumn("labels", label_array(self.labels))
        named.write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NaiveBayes:
        table = spark.read.parquet(path)
        labels = table.select("labels").first()[0]
        return NaiveBayes(list(labels), table.drop("labels"))


def train_naive_bayes(train: DataFrame, labels: Sequence[str]) -> NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing, per dictionary.

    ``train`` has ``dictionary, label, text``; ``labels`` is the label index.
    A label without training texts gets the weight of minus infinity.
    """
    labels = list(labels)
    per_label = [f"c{i}" for i in range(len(labels))]

    def counts() -> list[Column]:
        return [
            F.count_if(F.col("label") == label).alias(c) for c, label in zip(per_label, labels)
        ]

    tokens = train.select("dictionary", "label", F.explode(words_of(F.col("text"))).alias("token"))
    vocabulary = tokens.groupBy("dictionary", "token").agg(*counts())
    # one row per dictionary
    totals = vocabulary.groupBy("dictionary").agg(
        F.count(F.lit(1)).alias("words"), *[F.sum(c).alias(f"t_{c}") for c in per_label]
    )
    weights = vocabulary.join(F.broadcast(totals), "dictionary").select(
        "dictionary",
        "token",
        sum((F.col(c) for c in per_label), F.lit(0)).cast("bigint").alias("n"),
        F.array(
            *[
                F.log((F.col(c) + 1).cast("double") / (F.col(f"t_{c}") + F.col("words")))
                for c in per_label
            ]
        ).alias("w"),
    )
    sizes = train.groupBy("dictionary").agg(*counts())
    whole = sum((F.col(c) for c in per_label), F.lit(0))
    priors = sizes.select(
        "dictionary",
        F.lit(_PRIOR).alias("token"),
        # sorts the prior ahead of every word
        F.lit(2**62).cast("bigint").alias("n"),
        F.array(
            *[
                F.when(F.col(c) > 0, F.log(F.col(c).cast("double") / whole)).otherwise(
                    F.lit(-math.inf)
                )
                for c in per_label
            ]
        ).alias("w"),
    )
    return NaiveBayes(labels, weights.unionByName(priors))


def naive_bayes_scores(
    entries: DataFrame, model: NaiveBayes, carry: Sequence[str] = ()
) -> DataFrame:
    """``dictionary, id, *carry, trained, s0, s1, ...``: the log score of each class.

    Tokens that are frequent in training meet their weights in a table of
    bounded size, so the few words that make up most of all texts are summed up
    where they are read. Only the other tokens are shuffled, in a second pass over the
    texts; a model within the bound needs none. Unseen tokens drop. Entries of a dictionary
    that had no training rows are not ``trained`` and have null scores. Weights that are not stored are worked out anew by each use.
    """
    keep = ["dictionary", "id", *carry]
    width = len(model.labels)
    words = F.concat(F.array(F.lit(_PRIOR)), words_of(F.coalesce("text", F.lit(""))))
    tokens = entries.select(*keep, F.explode(words).alias("token"))
    limit = min(FREQUENT_WORDS, max(8192, FREQUENT_NUMBERS // max(width, 1)))
    whole = model.weights.limit(limit + 1).count() <= limit
    # the bound leaves room for one prior per dictionary ahead of the words
    ranked = model.weights if whole else model.weights.orderBy(F.desc("n"), "dictionary", "token").limit(limit)
    frequent = ranked.select("dictionary", "token", "w")
    keys = ["dictionary", "token"]
    near = tokens.join(F.broadcast(frequent), keys, "left").filter(F.col("w").isNotNull() | (F.col("token") == _PRIOR))
    sums = [F.bool_or(F.col("w").isNotNull()).alias("trained"), *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(width)]]
    if whole:
        return near.groupBy(*keep).agg(*sums)
    far = tokens.join(F.broadcast(frequent.select(*keys)), keys, "left_anti")
    rest = model.weights.join(F.broadcast(frequent.select(*keys)), keys, "left_anti")
    far = lookup_join(far, rest.select(*keys, "w"), keys, "inner")
    return near.unionByName(far).groupBy(*keep).agg(*sums)


def apply_naive_bayes(
    entries: DataFrame, model: NaiveBayes, carry: Sequence[str] = ()
) -> DataFrame:
    """``dictionary, id, *carry, label_out, prob_out`` for every entry.

    ``carry`` names the entry columns wanted in the result; texts are better
    joined back by ``id`` where they are needed. Entries of a dictionary that had no
    training rows come out with a null label and probability.
    """
    scores = naive_bayes_scores(entries, model, carry)
    values = F.array(*[F.col(f"s{i}") for i in range(len(model.labels))])
    return scores.withColumn("_s", values).select(
        "dictionary",
        "id",
        *carry,
        F.when(F.col("trained"), best_label(F.col("_s"), label_array(model.labels))).alias("label_out"),
        F.when(F.col("trained"), best_probability(F.col("_s"))).alias("prob_out"),
    )


def encode_text(entries: DataFrame, buckets: int = 1 << 18) -> DataFrame:
    """``features``: hashed word counts of ``text`` in a fixed number of buckets."""
    stages = _features(buckets)
    out = entries
    for step in stages:
        out = step.transform(out)
    return out


def _features(buckets: int) -> list:
    tokenizer = SQLTransformer(
        statement=(
            "SELECT *, regexp_extract_all(lower(coalesce(text, '')), '(\\\\p{L}+)', 1) AS _tokens"
            " FROM __THIS__"
        )
    )
    hashing = HashingTF(inputCol="_tokens", outputCol="features", numFeatures=buckets)
    return [tokenizer, hashing]


def train_logistic(
    train: DataFrame,
    buckets: int = 1 << 18,
    max_iter: int = 20,
    reg: float = 0.01,
) -> PipelineModel:
    """Logistic regression on weighted hashed word counts; ``train`` has ``text, label``."""
    stages = [
        *_features(buckets),
        IDF(inputCol="features", outputCol="_weighted"),
        StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc"),
        LogisticRegression(
            featuresCol="_weighted",
            labelCol="_y",
            predictionCol="_best",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            maxIter=max_iter,
            regParam=reg,
        ),
    ]
    model = Pipeline(stages=stages).fit(train.select("text", "label"))
    # the summary holds the session, which cannot be sent to tasks once it has observed an output
    nothing = train.sparkSession.sparkContext._jvm.scala.Option.empty()
    model.stages[-1]._java_obj.setSummary(nothing)
    return model


def apply_logistic(entries: DataFrame, model: PipelineModel) -> DataFrame:
    """Entries with ``label_out, prob_out``; nothing is shuffled."""
    *encoders, indexer, classifier = model.stages
    out = entries
    for step in (*encoders, classifier):
        out = step.transform(out)
    named = IndexToString(inputCol="_best", outputCol="label_out", labels=indexer.labels)
    probability = F.array_max(vector_to_array("_probability"))
    return named.transform(out).select(
        *entries.columns, "label_out", probability.alias("prob_out")
    )


BatchModel = Callable[[pd.DataFrame], pd.DataFrame]


def apply_function(
    entries: DataFrame, load: Callable[[], BatchModel]
) -> DataFrame:
    """Entries with the ``label_out, prob_out`` a model of one's own gives them.

    ``load`` is called once per task and returns a function from a batch of
    entries to a frame with the two columns, row for row. A batch is bounded in rows
    and in bytes; the entries themselves pass by as they came.
    """
    schema = T.StructType(
        [
            *entries.schema.fields,
            T.StructField("label_out", T.StringType()),
            T.StructField("prob_out", T.DoubleType()),
        ]
    )
    names = schema.names
    zone = entries.sparkSession.conf.get("spark.sql.session.timeZone")

    size = BATCH_BYTES

    def frame(batch: pa.RecordBatch) -> pd.DataFrame:
        """As Spark hands it to pandas functions: times without zone, in the session's."""
        out = batch.to_pandas(date_as_object=True)
        for name, kind in zip(batch.schema.names, batch.schema.types, strict=True):
            if pa.types.is_timestamp(kind) and kind.tz:
                out[name] = out[name].dt.tz_convert(zone).dt.tz_localize(None)
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            rows = max(1, batch.num_rows * size // max(batch.nbytes, size))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = model(frame(part))
                labels = pa.array(out["label_out"].to_numpy(), pa.string(), from_pandas=True)
                probs = pa.array(out["prob_out"].to_numpy(float, na_value=np.nan), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([*part.columns, labels, probs], names)

    return entries.mapInArrow(score, schema)


Predictor = Callable[..., dict]


def apply_predictor(
    entries: DataFrame, make: Callable[[], Predictor], columns: Sequence[str] = ("text",), key: str = "id", batch_size: int = 1024
) -> DataFrame:
    """Entries with the ``label_out, prob_out`` of a model that is loaded once a worker.

    ``make`` loads the model and returns a function from arrays, one for each of ``columns``, to a dict of
    arrays ``label_out`` and ``prob_out``. A worker that runs many tasks keeps it. A batch that the function
    fails on, or gives another number of labels for, ends the job with the keys of its first and last entry.
    """
    def load():
        predict = make()

        def named(keys, *arrays):
            try:
                out = predict(*arrays)
                sizes = {len(out["label_out"]), len(out["prob_out"])}
                if sizes != {len(keys)}:
                    raise ValueError(f"{len(keys)} entries, but {sorted(sizes)} labels and probabilities")
            except Exception as error:
                raise RuntimeError(f"batch of entries {keys[0]} to {keys[-1]}: {error}") from error
            return {"label_out": np.array(out["label_out"], dtype=object), "prob_out": np.asarray(out["prob_out"], float)}

        # the columns are counted by the arguments of the function
        arguments = [inspect.Parameter(f"c{i}", inspect.Parameter.POSITIONAL_ONLY) for i in range(len(columns) + 1)]
        named.__signature__ = inspect.Signature(arguments)
        return named

    found = T.StructType([T.StructField("label_out", T.StringType()), T.StructField("prob_out", T.DoubleType())])
    scored = predict_batch_udf(load, return_type=found, batch_size=batch_size)
    rows = entries.withColumn("_out", scored(F.col(key).cast("string"), *[F.col(c) for c in columns]))
    kept = [c for c in entries.columns if c not in found.names]
    return rows.select(*kept, "_out.label_out", "_out.prob_out")

"""A softmax classifier on piece ids, trained by epochs of partial gradients.

A text is the shares of its pieces (with the begin and end pieces, which act as the bias), a class
the sum of its weights for them. In each step every task reads its rows once, adds up the gradient of
its own and sends one row per dictionary and piece; these are summed by piece, and the weights
move against them by the learning rate. Weights have the size of vocabulary, labels and dictionaries,
which are parameters: they are checked against ``MAX_WEIGHTS``, then broadcast.

The weights after each epoch are a table of their own, so that training goes on
where it stopped. One model per dictionary, all trained in the same passes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termtide.functions.labels import label_array
from termtide.operators.encoding import used_ids
from termtide.session import local_table, path_exists, ship_package

MAX_WEIGHTS = 1 << 25
_SCHEMA = "dictionary string, piece int, w array<double>"


class OtherTrainingError(ValueError):
    """The folder holds a training with other parameters."""


@dataclass(frozen=True)
class Training:
    """``batches`` steps an epoch, each on the rows a seeded hash of the id gives it; one is the full gradient."""

    epochs: int = 5
    rate: float = 5.0
    batches: int = 1
    decay: float = 0.0
    seed: int = 0


@dataclass(frozen=True)
class SoftmaxModel:
    """``weights`` per dictionary: an array of pieces by labels."""

    labels: list[str]
    weights: dict[str, np.ndarray]

    def table(self, spark: SparkSession) -> DataFrame:
        """``dictionary, piece, w`` of the pieces that have a weight."""
        names, pieces, rows = [], [], []
        for name, array in self.weights.items():
            used = np.flatnonzero(array.any(axis=1))
            names += [name] * len(used)
            pieces.append(used.astype(np.int32))
            rows.append(array[used])
        flat = np.concatenate(rows) if rows else np.zeros((0, len(self.labels)))
        offsets = np.arange(len(flat) + 1, dtype=np.int32) * len(self.labels)
        columns = {
            "dictionary": pa.array(names, pa.string()),
            "piece": pa.array(np.concatenate(pieces) if pieces else [], pa.int32()),
            "w": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel())),
        }
        return spark.createDataFrame(pa.table(columns), _SCHEMA)

    def probabilities(self, name: str, starts: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Of each label, for texts whose piece ids follow one another."""
        return _softmax(_logits(self.weights[name], starts, pieces))


def _logits(weights: np.ndarray, starts: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The mean weight of the pieces of each text; every text has pieces."""
    sizes = np.diff(np.append(starts, len(pieces)))
    return np.add.reduceat(weights[pieces], starts, axis=0) / sizes[:, None]


def _softmax(scores: np.ndarray) -> np.ndarray:
    shares = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shares / shares.sum(axis=1, keepdims=True)


def _slopes(weights: np.ndarray, starts: np.ndarray, pieces: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, float]:
    """The summed gradient and the summed loss of some texts."""
    shares = _softmax(_logits(weights, starts, pieces))
    rows = np.arange(len(starts))
    loss = -float(np.log(np.maximum(shares[rows, classes], 1e-300)).sum())
    shares[rows, classes] -= 1.0
    sizes = np.diff(np.append(starts, len(pieces)))
    spread = np.repeat(shares / sizes[:, None], sizes, axis=0)
    gradient = [np.bincount(pieces, spread[:, c], minlength=len(weights)) for c in range(weights.shape[1])]
    return np.stack(gradient, axis=1), loss


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Per dictionary of a batch: its rows, where the ids of each start, and the ids."""
    names = batch.column("dictionary")
    for value in names.unique().to_pylist():
        rows = np.flatnonzero(np.array([n == value for n in names.to_pylist()]))
        lists = batch.column(name).take(pa.array(rows))
        sizes = np.array([len(x) for x in lists.to_pylist()], np.int64)
        yield value, rows, np.cumsum(sizes) - sizes, lists.flatten().to_numpy(zero_copy_only=False)


def _gradient(rows: DataFrame, model: SoftmaxModel) -> pa.Table:
    """``dictionary, piece, g0, g1, ...`` summed over ``rows``; piece -1 holds the number of rows and the loss."""
    labels = [f"g{i}" for i in range(len(model.labels))]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, list[float]] = {}
        for batch in batches:
            for name, at, starts, pieces in _texts(batch, "ids"):
                classes = batch.column("class").to_numpy()[at]
                gradient, loss = _slopes(own.weights[name], starts, pieces, classes)
                if name in sums:
                    sums[name] += gradient
                else:
                    sums[name] = gradient
                count = seen.setdefault(name, [0.0, 0.0])
                count[0] += len(at)
                count[1] += loss
        for name, gradient in sums.items():
            used = np.flatnonzero(gradient.any(axis=1))
            head = np.zeros((1, gradient.shape[1]))
            table = np.concatenate([head, gradient[used]])
            facts = np.zeros((len(table), 2))
            facts[0] = seen[name]
            pieces = np.concatenate([[-1], used])
            arrays = [pa.array([name] * len(table)), pa.array(pieces, pa.int32()), *map(pa.array, table.T), *map(pa.array, facts.T)]
            yield pa.RecordBatch.from_arrays(arrays, ["dictionary", "piece", *labels, "n", "loss"])

    numbers = ", ".join(f"{c} double" for c in (*labels, "n", "loss"))
    parts = rows.mapInArrow(run, f"dictionary string, piece int, {numbers}")
    return parts.groupBy("dictionary", "piece").agg(*[F.sum(c).alias(c) for c in (*labels, "n", "loss")]).toArrow()


def _moved(model: SoftmaxModel, gradient: pa.Table, training: Training) -> tuple[SoftmaxModel, dict[str, float]]:
    """The model after one step, and the mean loss per dictionary before it."""
    names = np.array(gradient["dictionary"].to_pylist(), dtype=object)
    pieces = gradient["piece"].to_numpy()
    values = np.stack([gradient[f"g{i}"].to_numpy() for i in range(len(model.labels))], axis=1)
    weights, losses = {}, {}
    for name, old in model.weights.items():
        own = names == name
        if not own.any():
            weights[name] = old
            continue
        head = own & (pieces < 0)
        count = float(gradient["n"].to_numpy()[head][0])
        losses[name] = float(gradient["loss"].to_numpy()[head][0]) / count
        slope = np.zeros_like(old)
        body = own & (pieces >= 0)
        slope[pieces[body]] = values[body]
        weights[name] = old - training.rate * (slope / count + training.decay * old)
    return SoftmaxModel(model.labels, weights), losses


def train_softmax(
    train: DataFrame, labels: Sequence[str], pieces: int, path: str, training: Training | None = None
) -> SoftmaxModel:
    """Trains on ``dictionary, id, label, input_ids, attention_mask`` below ``path`` and returns the last model.

    ``pieces`` is the size of the vocabulary. Epochs found in the folder are not trained again; a folder of a
    training with other parameters is an error. Rows without label take no part.
    """
    training = training or Training()
    spark = train.sparkSession
    ship_package(spark)
    labels = list(labels)
    names = sorted(r[0] for r in train.select("dictionary").distinct().collect())  # one row per dictionary
    if pieces * len(labels) * max(len(names), 1) > MAX_WEIGHTS:
        raise ValueError(f"{pieces} pieces, {len(labels)} labels and {len(names)} dictionaries make more than {MAX_WEIGHTS} weights")
    mark = {**asdict(training), "labels": labels, "pieces": pieces, "dictionaries": names}
    mark.pop("epochs")
    if path_exists(spark, f"{path}/training/_SUCCESS"):
        if json.loads(spark.read.text(f"{path}/training").first()[0]) != mark:
            raise OtherTrainingError(path)
    else:
        local_table(spark, {"value": [json.dumps(mark)]}).coalesce(1).write.mode("overwrite").text(f"{path}/training")
    done = 0
    while done < training.epochs and path_exists(spark, f"{_epoch(path, done + 1)}/_SUCCESS"):
        done += 1
    model = SoftmaxModel(labels, {n: np.zeros((pieces, len(labels))) for n in names})
    if done:
        model = load_softmax(spark, path, done)
    known = label_array(labels)
    rows = train.filter(F.array_contains(known, F.col("label"))).select(
        "dictionary",
        "id",
        (F.array_position(known, F.col("label")) - 1).cast("int").alias("class"),
        used_ids().alias("ids"),
    )
    turn = F.pmod(F.xxhash64(F.col("id"), F.lit(training.seed)), F.lit(training.batches))
    for epoch in range(done + 1, training.epochs + 1):
        for step in range(training.batches):
            part = rows if training.batches == 1 else rows.filter(turn == step)
            model, losses = _moved(model, _gradient(part.drop("id"), model), training)
        whole = model.table(spark).withColumns({"labels": label_array(labels), "pieces": F.lit(pieces)})
        losses_of = F.create_map(*[F.lit(x) for pair in losses.items() for x in pair]) if losses else F.create_map()
        loss = F.try_element_at(losses_of.cast("map<string,double>"), F.col("dictionary"))
        whole.withColumn("loss", loss).write.mode("overwrite").parquet(_epoch(path, epoch))
    return model


def _epoch(path: str, epoch: int) -> str:
    return f"{path}/epoch-{epoch:05d}"


def load_softmax(spark: SparkSession, path: str, epoch: int) -> SoftmaxModel:
    """The model after an epoch."""
    mark = json.loads(spark.read.text(f"{path}/training").first()[0])
    labels = mark["labels"]
    weights = {n: np.zeros((mark["pieces"], len(labels))) for n in mark["dictionaries"]}
    rows = spark.read.parquet(_epoch(path, epoch)).select("dictionary", "piece", "w").toArrow()
    names = np.array(rows["dictionary"].to_pylist(), dtype=object)
    pieces = rows["piece"].to_numpy()
    values = rows["w"].combine_chunks().flatten().to_numpy().reshape(len(pieces), len(labels))
    for name, array in weights.items():
        own = names == name
        array[pieces[own]] = values[own]
    return SoftmaxModel(labels, weights)


def apply_softmax(entries: DataFrame, model: SoftmaxModel, carry: Sequence[str] = ()) -> DataFrame:
    """``dictionary, id, *carry, label_out, prob_out`` of encoded entries; of equal classes the first counts.

    Entries of a dictionary that was not trained come out with null. Nothing is shuffled.
    """
    ship_package(entries.sparkSession)
    shared = entries.sparkSession.sparkContext.broadcast(model)
    rows = entries.select("dictionary", "id", *carry, used_ids().alias("_ids"))
    kept = [c for c in rows.columns if c != "_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            best = np.full(batch.num_rows, -1)
            prob = np.full(batch.num_rows, np.nan)
            for name, at, starts, pieces in _texts(batch, "_ids"):
                if name in own.weights:
                    shares = own.probabilities(name, starts, pieces)
                    best[at], prob[at] = shares.argmax(axis=1), shares.max(axis=1)
            out = [own.labels[b] if b >= 0 else None for b in best]
            scores = pa.array(prob, mask=np.isnan(prob))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(out, pa.string()), scores], [*kept, "label_out", "prob_out"]
            )

    found = [T.StructField("label_out", T.StringType()), T.StructField("prob_out", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*rows.drop("_ids").schema.fields, *found]))

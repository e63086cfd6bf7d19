import numpy as np
import pytest

from termtide.operators import softmax
from termtide.operators.softmax import OtherTrainingError, Training, apply_softmax, load_softmax, train_softmax

LABELS = ["animal", "food", "tool"]
PIECES = 12


def some_rows(n=120):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        size = int(rng.integers(1, 7))
        ids = [2, *(int(x) for x in rng.integers(4, PIECES, size)), 3]
        label = None if i % 17 == 0 else LABELS[int(sum(ids)) % 2 + (i % 19 == 0)]
        rows.append(("d0" if i % 3 else "d1", i, label, ids + [0] * (9 - len(ids)), [1] * len(ids) + [0] * (9 - len(ids))))
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_rows()


@pytest.fixture(scope="module")
def train(spark, rows):
    return spark.createDataFrame(rows, "dictionary string, id int, label string, input_ids array<int>, attention_mask array<int>").repartition(5)


def plain(rows, name, epochs, rate, decay=0.0):
    """Training with dense matrices."""
    own = [r for r in rows if r[0] == name and r[2]]
    x = np.zeros((len(own), PIECES))
    for i, r in enumerate(own):
        used = [p for p, m in zip(r[3], r[4], strict=True) if m]
        for p in used:
            x[i, p] += 1 / len(used)
    y = np.eye(len(LABELS))[[LABELS.index(r[2]) for r in own]]
    w = np.zeros((PIECES, len(LABELS)))
    for _ in range(epochs):
        e = np.exp(x @ w)
        w = w - rate * (x.T @ (e / e.sum(axis=1, keepdims=True) - y) / len(own) + decay * w)
    return w, x


@pytest.mark.parametrize("decay", [0.0, 0.1])
def test_same_as_dense_matrices(train, rows, tmp_path, decay):
    model = train_softmax(train, LABELS, PIECES, str(tmp_path / "m"), Training(epochs=4, rate=3.0, decay=decay))
    for name in ("d0", "d1"):
        assert np.abs(model.weights[name] - plain(rows, name, 4, 3.0, decay)[0]).max() < 1e-9


def test_goes_on_after_each_epoch(spark, train, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    train_softmax(train, LABELS, PIECES, path, Training(epochs=2, rate=3.0))
    steps = []
    gradient = softmax._gradient
    monkeypatch.setattr(softmax, "_gradient", lambda *a: steps.append(1) or gradient(*a))
    model = train_softmax(train, LABELS, PIECES, path, Training(epochs=5, rate=3.0))
    assert len(steps) == 3
    assert np.abs(model.weights["d0"] - plain(rows, "d0", 5, 3.0)[0]).max() < 1e-9
    again = train_softmax(train, LABELS, PIECES, path, Training(epochs=5, rate=3.0))
    assert len(steps) == 3 and np.array_equal(again.weights["d1"], model.weights["d1"])
    assert np.abs(load_softmax(spark, path, 2).weights["d1"] - plain(rows, "d1", 2, 3.0)[0]).max() < 1e-9
    losses = [spark.read.parquet(softmax._epoch(path, e)).filter("dictionary = 'd0'").first()["loss"] for e in range(1, 6)]
    assert losses == sorted(losses, reverse=True) and losses[0] == pytest.approx(np.log(3))
    with pytest.raises(OtherTrainingError):
        train_softmax(train, LABELS, PIECES, path, Training(epochs=5, rate=1.0))


def test_batches_take_every_row_once(train, tmp_path, monkeypatch):
    seen = []
    gradient = softmax._gradient

    def counted(part, model):
        seen.append(part.count())
        return gradient(part, model)

    monkeypatch.setattr(softmax, "_gradient", counted)
    train_softmax(train, LABELS, PIECES, str(tmp_path / "m"), Training(epochs=2, batches=4))
    labelled = train.filter("label is not null").count()
    assert len(seen) == 8 and sum(seen[:4]) == sum(seen[4:]) == labelled


def test_apply(spark, train, rows, tmp_path):
    model = train_softmax(train, LABELS, PIECES, str(tmp_path / "m"), Training(epochs=6, rate=4.0))
    other = spark.createDataFrame([("new", 900, None, [2, 3], [1, 1])], train.schema)
    got = {r.id: r for r in apply_softmax(train.unionByName(other), model, ["label"]).collect()}
    for name in ("d0", "d1"):
        w, x = plain(rows, name, 6, 4.0)
        e = np.exp(x @ w)
        shares = e / e.sum(axis=1, keepdims=True)
        own = [r for r in rows if r[0] == name and r[2]]
        for r, p in zip(own, shares, strict=True):
            assert got[r[1]].prob_out == pytest.approx(p.max(), abs=1e-9)
            assert got[r[1]].label_out == LABELS[int(p.argmax())] and got[r[1]].label == r[2]
    assert got[900].label_out is None and got[900].prob_out is None
    assert apply_softmax(train.limit(0), model).count() == 0


def test_too_many_weights(train, tmp_path, monkeypatch):
    monkeypatch.setattr(softmax, "MAX_WEIGHTS", 50)
    with pytest.raises(ValueError, match="weights"):
        train_softmax(train, LABELS, PIECES, str(tmp_path / "m"))

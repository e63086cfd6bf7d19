import pandas as pd
import pytest
from pyspark.sql import functions as F

from termtide.operators.classifiers import NaiveBayesClassifier, OwnClassifier, SoftmaxClassifier
from termtide.operators.encoding import Vocabulary
from termtide.operators.softmax import Training
from termtide.operators.splitting import SplitSize
from termtide.plans import experiment
from termtide.plans.dataset import EntryRules
from termtide.plans.expansion import expand_lexicon
from termtide.plans.experiment import Experiment, ExperimentConf, ExperimentExistsError, input_mark
from termtide.sources.observed import manifest_of

ANIMALS = ["bark", "tail", "fur", "paw"]
FOODS = ["sweet", "cook", "taste", "eat"]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(f"w{i}", "animal" if i % 2 else "food", i) for i in range(40)]
    return spark.createDataFrame(rows, "word string, label string, ord bigint")


@pytest.fixture(scope="module")
def entries(spark):
    rows = []
    for d in ("d0", "d1"):
        for i in range(60):
            clues = ANIMALS if i % 2 else FOODS
            text = " ".join(clues[(i + k) % 4] for k in range(3))
            rows.append((d, i, f"w{i}", text, i % 5))
    return spark.createDataFrame(
        rows, "dictionary string, id bigint, word string, text string, quality int"
    )


def conf(**changes):
    settings = {"name": "exp", "size": SplitSize(count=6), "rules": EntryRules(top_n=3), "report_threshold": 0.5}
    return ExperimentConf(**{**settings, **changes})


def test_run_resume_and_overwrite(spark, lexicon, entries, tmp_path):
    root = str(tmp_path)
    run = Experiment(conf(), entries, lexicon, root)
    assert run.run() is True
    assert run.finished()
    assert run.split("test").count() == 12 and run.split("train").count() == 68
    summary = {r["dictionary"]: r for r in run.summary().collect()}
    # the clues tell the labels apart, and words 40 to 59 are new (4 of 20 have quality 0)
    for row in summary.values():
        assert (row["train_count"], row["f_score"], row["accuracy"], row["new_terms"]) == (34, 1.0, 1.0, 16)
    grown = run.expanded().collect()
    assert {(r["dictionary"], r["term"]) for r in grown} == {
        (d, f"w{i}") for d in ("d0", "d1") for i in range(40, 60)
    }
    assert all(r["label"] == ("animal" if int(r["term"][1:]) % 2 else "food") for r in grown)

    # a finished experiment is left alone, other parameters are refused
    again = Experiment(conf(), entries, lexicon, root)
    assert again.run() is False
    assert again.summary().count() == 2
    with pytest.raises(ExperimentExistsError):
        Experiment(conf(label_threshold=0.9), entries, lexicon, root).run()
    other = Experiment(conf(label_threshold=2.0), entries, lexicon, root, overwrite=True)
    assert other.run() is True
    assert other.expanded().count() == 0


def test_failed_run_is_taken_up(spark, lexicon, entries, tmp_path, monkeypatch):
    class Broken(NaiveBayesClassifier):
        def apply(self, *_):
            raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        Experiment(conf(), entries, lexicon, str(tmp_path), classifier=Broken()).run()
    run = Experiment(conf(), entries, lexicon, str(tmp_path))
    assert not run.finished()
    made = noted_stages(monkeypatch)
    assert run.run() is True
    assert made == ["test_scored", "scored", "expanded", "summary"]


def noted_stages(monkeypatch):
    """The stages that are written from now on."""
    made = []
    write = experiment.write_observed

    def noted(rows, path, *args, **options):
        made.append(path.split("/")[-2])
        return write(rows, path, *args, **options)

    monkeypatch.setattr(experiment, "write_observed", noted)
    return made


def as_files(spark, table, path):
    table.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_a_finished_run_reads_no_input(spark, lexicon, entries, tmp_path, monkeypatch):
    made = [as_files(spark, t, str(tmp_path / n)) for t, n in ((entries, "e"), (lexicon, "l"))]
    assert Experiment(conf(), *made, str(tmp_path)).run() is True
    monkeypatch.setattr(Experiment, "_contents", lambda self: 1 / 0)
    again = Experiment(conf(), spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "l")), str(tmp_path))
    assert again.run() is False and again.summary().count() == 2
    # another plan over the same files is another input
    with pytest.raises(ZeroDivisionError):
        Experiment(conf(), made[0].filter("id > 0"), made[1], str(tmp_path)).run()
    assert input_mark(entries) is None


def test_one_changed_dictionary_reruns_that_one(spark, lexicon, entries, tmp_path, monkeypatch):
    root, by = str(tmp_path), "dictionary"
    run = Experiment(conf(), entries, lexicon, root)
    run.run()
    first = {r[by]: r for r in run.summary().collect()}
    models = run._at("model", 0)
    # new words only: neither common words nor label shares change
    changed = entries.withColumn("text", F.when((F.col(by) == "d1") & (F.col("id") >= 40), "eat cook").otherwise(F.col("text")))
    with pytest.raises(ExperimentExistsError):
        Experiment(conf(), changed, lexicon, root).run()
    made, seen = noted_stages(monkeypatch), []
    fit = NaiveBayesClassifier.fit
    monkeypatch.setattr(NaiveBayesClassifier, "fit", lambda self, train, *a: seen.extend(r[0] for r in train.select(by).distinct().collect()) or fit(self, train, *a))
    again = Experiment(conf(), changed, lexicon, root, refresh=True)
    assert again.run() is True and seen == ["d1"]
    assert made == ["valid", "words", "terms", "dataset", "test_scored", "scored", "expanded", "summary"]
    assert spark.read.parquet(again._at("scored", 1)).select(by).distinct().collect()[0][0] == "d1"
    assert again.scored().count() == 120 and again.split("test").count() == 12
    grown = {(r[by], r["term"]): r["label"] for r in again.expanded().collect()}
    assert {v for (d, _), v in grown.items() if d == "d1"} == {"food"}
    assert {v for (d, _), v in grown.items() if d == "d0"} == {"food", "animal"}
    assert {r[by]: r for r in again.summary().collect()}["d0"] == first["d0"] and models != again._at("model", 1)
    assert Experiment(conf(), changed, lexicon, root).run() is False
    fresh = Experiment(conf(name="fresh"), changed, lexicon, root)
    fresh.run()
    for name in ("dataset", "test_scored", "scored", "expanded", "summary"):
        a, b = again._read(name), fresh._read(name)
        columns = sorted(a.columns)
        assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


@pytest.mark.parametrize("label", ["food", "plant"])
def test_a_failed_refresh_is_taken_up(spark, lexicon, entries, tmp_path, label):
    root = str(tmp_path)
    labels = lexicon.withColumn("label", F.when(F.col("word") == "w39", label).otherwise(F.col("label")))
    late = entries.filter("id < 59 or dictionary = 'd0'").filter("id <> 39")
    Experiment(conf(), late, labels, root).run()

    class Broken(NaiveBayesClassifier):
        def apply(self, entries, path, carry=()):
            if "label" not in entries.columns:
                raise ZeroDivisionError
            return super().apply(entries, path, carry)

    grown = late.unionByName(entries.filter("id = 39 and dictionary = 'd1'"))
    with pytest.raises(ZeroDivisionError):
        Experiment(conf(), grown, labels, root, refresh=True, classifier=Broken()).run()
    again = Experiment(conf(), grown, labels, root, refresh=True)
    assert again.run() is True
    fresh = Experiment(conf(name="fresh"), grown, labels, root)
    fresh.run()
    for name in ("dataset", "test_scored", "scored", "expanded", "summary"):
        a, b = again._read(name), fresh._read(name)
        columns = sorted(a.columns)
        assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


def test_changed_terms_and_dictionaries_that_come_or_go(spark, lexicon, entries, tmp_path):
    root = str(tmp_path)
    Experiment(conf(), entries, lexicon, root).run()
    more = entries.filter("dictionary = 'd0' and id >= 10").withColumn("dictionary", F.lit("d2"))
    grown = entries.filter("dictionary = 'd1'").unionByName(more)
    again = Experiment(conf(), grown, lexicon, root, refresh=True)
    assert again.run() is True
    fresh = Experiment(conf(name="fresh"), grown, lexicon, root)
    fresh.run()
    for name in ("dataset", "test_scored", "scored", "expanded", "summary"):
        a, b = again._read(name), fresh._read(name)
        columns = sorted(a.columns)
        assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))
    words = {r[0] for r in again.split("test").select("word").collect()}
    assert not words & {r[0] for r in again.split("train").select("word").collect()}


def test_manifests_with_results(spark, lexicon, entries, tmp_path):
    run = Experiment(conf(), entries, lexicon, str(tmp_path))
    run.run()
    facts = run.manifest()
    assert facts["labels"] == ["animal", "food"] and facts["results"]["d0"]["f_score"] == 1.0
    assert facts["stages"]["dataset"]["0"]["rows"] == 80 and facts["stages"]["scored"]["0"]["rows"] == 120
    own = manifest_of(spark, run._at("summary", 0))
    assert own["results"]["d1"]["accuracy"] == 1.0 and own["conf"]["name"] == "exp"


def test_other_classifiers(spark, lexicon, entries, tmp_path):
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *ANIMALS, *FOODS]
    softmax = SoftmaxClassifier(Vocabulary({p: i for i, p in enumerate(pieces)}), 8, Training(epochs=6, rate=8.0))
    run = Experiment(conf(), entries, lexicon, str(tmp_path), classifier=softmax)
    assert run.run() is True
    assert all(r["f_score"] == 1.0 and r["new_terms"] == 16 for r in run.summary().collect())
    with pytest.raises(ExperimentExistsError):
        Experiment(conf(), entries, lexicon, str(tmp_path)).run()
    assert run.manifest()["classifier"]["epochs"] == 6

    def load():
        def by_clue(batch):
            animal = batch["text"].str.contains("bark|tail|fur|paw")
            return pd.DataFrame({"label_out": animal.map({True: "animal", False: "food"}), "prob_out": 0.75})

        return by_clue

    own = Experiment(conf(name="own"), entries, lexicon, str(tmp_path), classifier=OwnClassifier("clues-1", load))
    assert own.run() is True
    assert all(r["accuracy"] == 1.0 and r["new_terms"] == 16 for r in own.summary().collect())


def test_without_labelling_dictionaries(spark, lexicon, entries, tmp_path):
    run = Experiment(conf(label_dictionaries=False), entries, lexicon, str(tmp_path))
    assert run.run() is True
    assert run.test_scored().count() == 12
    with pytest.raises(Exception):
        run.expanded().count()


def test_expand_lexicon(spark, lexicon):
    rows = [
        (1, "new", "a", 0.99),
        (2, "new", "b", 0.6),
        (3, "New2", "a", 0.4),
        (4, "W1", "a", 0.9),
        (5, "new", "c", 0.2),
    ]
    scored = spark.createDataFrame(rows, "id bigint, word string, label_out string, prob_out double")

    def terms(**options):
        return {r["term"]: r["label"] for r in expand_lexicon(scored, lexicon, **options).collect()}

    assert terms() == {"new": "c", "new2": "a"}
    assert terms(threshold=0.5) == {"new": "b"}
    assert terms(threshold=0.5, keep="best") == {"new": "a"}
    with pytest.raises(ValueError):
        terms(keep="any")

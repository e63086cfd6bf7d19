"""The whole chain for one lexicon and its dictionaries, stage by stage on disk.

Stages of a run: ``valid``, ``words``, ``terms``, ``dataset``, ``model``, ``test_scored``,
``scored``, ``expanded``, ``summary`` and, last, ``manifest``. A stage the run has
finished is read, not made again, when the run is taken up after a failure. Beside each stage lies its
manifest with counts taken while it was written.

A run knows its inputs by a mark that costs no reading where they are files (names, sizes, times and
the plan over them), and by a fingerprint per dictionary: the number of rows and a sum of their hashes, which
merges in any order. A finished run whose marks are the same reads nothing. With ``refresh`` a run whose
dictionaries have changed begins a new generation: its stages are made for the changed dictionaries only, and
each dictionary is read from the generation it was made in. The test vocabulary is one for all
dictionaries; where a change moves it, data sets and models of all of them are made anew.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.functions.labels import label_array
from termtide.operators.classifiers import Classifier, NaiveBayesClassifier
from termtide.operators.labelling import new_terms
from termtide.operators.metrics import run_summary
from termtide.operators.selection import best_confidence, unlabelled_positive
from termtide.operators.splitting import SplitSize, split_dataset, test_terms, word_counts
from termtide.plans.dataset import EntryRules, valid_entries
from termtide.plans.expansion import expand_lexicon
from termtide.session import path_exists
from termtide.sources.files import file_marks, read_text, write_text
from termtide.sources.observed import add_results, manifest_of, write_observed

_SHARED = "*"  # in place of a dictionary: stages that are one for all


class ExperimentExistsError(FileExistsError):
    """The folder holds an experiment with other parameters or inputs."""


@dataclass(frozen=True)
class ExperimentConf:
    name: str
    size: SplitSize
    rules: EntryRules = field(default_factory=EntryRules)
    label_threshold: float = 0.0
    report_threshold: float = 0.98
    seed: int = 0
    label_dictionaries: bool = True

    def fingerprint(self) -> str:
        return _digest(asdict(self))


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def input_mark(table: DataFrame) -> str | None:
    """What tells whether a table over files is the same, without reading it; None for other tables.

    The files with their sizes and times, and the plan over them. Functions of one's own count by name.
    """
    analyzed = table._jdf.queryExecution().analyzed()
    leaves = analyzed.collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    if kinds - {"LogicalRelation"}:
        return None
    plan = re.sub(r"#[0-9]+L?", "", analyzed.treeString())
    return _digest([plan, file_marks(table.sparkSession, table.inputFiles())])


class Experiment:
    """Runs an experiment and gives access to its stages.

    ``entries`` has ``dictionary, id, word, text`` and maybe ``quality``. ``classifier`` is what
    is trained and applied, naive Bayes unless another is given.
    """

    def __init__(
        self,
        conf: ExperimentConf,
        entries: DataFrame,
        lexicon: DataFrame,
        root: str,
        exclusions: Sequence[DataFrame] = (),
        overwrite: bool = False,
        classifier: Classifier | None = None,
        refresh: bool = False,
    ):
        self.conf = conf
        self.entries = entries
        self.lexicon = lexicon
        self.exclusions = list(exclusions)
        self.overwrite = overwrite
        self.classifier = classifier or NaiveBayesClassifier()
        self.refresh = refresh
        self.path = f"{root.rstrip('/')}/{conf.name}"
        self._state: dict | None = None

    @property
    def _spark(self) -> SparkSession:
        return self.entries.sparkSession

    # --- what the folder holds

    def _current(self) -> dict:
        """The state of the last run begun in this folder, or nothing; read once."""
        if self._state is None:
            if not path_exists(self._spark, f"{self.path}/state.json"):
                return {}
            self._state = json.loads(read_text(self._spark, f"{self.path}/state.json"))
        return self._state

    def _keep(self, state: dict) -> None:
        self._state = state
        write_text(self._spark, f"{self.path}/state.json", json.dumps(state, sort_keys=True))

    def _settings(self) -> str:
        return _digest([self.conf.fingerprint(), self.classifier.describe()])

    def _marks(self) -> list[str | None]:
        return [input_mark(t) for t in (self.entries, self.lexicon, *self.exclusions)]

    def _contents(self) -> tuple[dict[str, str], str]:
        """A fingerprint of each dictionary, and one of the other inputs."""
        def total(table: DataFrame):
            return F.sum(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)")).cast("string")

        columns = sorted(self.entries.columns)
        # one row per dictionary
        rows = self.entries.groupBy("dictionary").agg(F.count(F.lit(1)).alias("n"), total(self.entries).alias("total")).collect()
        own = {r["dictionary"]: _digest([columns, r["n"], r["total"]]) for r in rows}
        others = []
        for table in (self.lexicon, *self.exclusions):
            row = table.agg(F.count(F.lit(1)).alias("n"), total(table).alias("total")).first()
            others.append([sorted(table.columns), row["n"], row["total"]])
        return own, _digest(others)

    def _at(self, stage: str, generation: int | None = None) -> str:
        base = f"{self.path}/run-{self._current()['run']}/{stage}"
        return base if generation is None else f"{base}/generation={generation}"

    def _done(self, stage: str) -> bool:
        return path_exists(self._spark, self._at(stage, self._current()["generation"]) + "/_SUCCESS")

    def finished(self) -> bool:
        return bool(self._current()) and self._current()["finished"]

    # --- running

    def _begin(self) -> None:
        """Go on with the last run, begin a new one in a folder of its own, or a new generation of it.

        Overwriting begins a new run, so stages of an earlier one, which may be
        for other parameters or inputs, are never taken for its own.
        """
        current = self._current()
        marks = self._marks()
        own, others = self._contents()
        if not current or self.overwrite:
            made = {"run": uuid.uuid4().hex, "settings": self._settings(), "generation": 0, "finished": False, "made": {}, "labels": None, "decided": {}}
            self._keep({**made, "marks": marks, "dictionaries": own, "others": others, "changed": sorted(own)})
            return
        changed = sorted(d for d in own if current["dictionaries"].get(d) != own[d])
        gone = sorted(d for d in current["dictionaries"] if d not in own)
        if current["settings"] != self._settings() or current["others"] != others or ((changed or gone) and not self.refresh):
            raise ExperimentExistsError(f"{self.path} holds an experiment with other parameters or inputs")
        if not (changed or gone):
            self._keep({**current, "marks": marks})
            return
        # what an unfinished generation has made may not fit together: all dictionaries are made anew
        renewed = changed if current["finished"] else sorted(own)
        state = {**current, "marks": marks, "dictionaries": own, "changed": renewed, "finished": False}
        self._keep({**state, "generation": current["generation"] + 1, "decided": {}})

    def _stage(self, name: str, make: Callable[[], DataFrame], dirty: Sequence[str], by: str | None = None) -> DataFrame:
        """The stage, made in this generation for the ``dirty`` dictionaries (or for all as one)."""
        state = self._current()
        if dirty and not self._done(name):
            rows = make()
            counts = {"rows": F.count(F.lit(1))}
            if "label" in rows.columns:
                counts["labels"] = F.collect_set("label")  # one row per label
            conf = {**asdict(self.conf), **self.classifier.describe(), "dictionaries": list(dirty)}
            path = self._at(name, state["generation"])
            write_observed(rows, path, conf, counts, overwrite=True, partition_by=(by,) if by else ())
        made = {**state["made"].get(name, {}), **{d: state["generation"] for d in dirty}}
        self._keep({**state, "made": {**state["made"], name: made}})
        return self._read(name)

    def _read(self, name: str) -> DataFrame:
        """Each dictionary's rows from the generation they were made in."""
        state = self._current()
        made = state["made"].get(name)
        if not made:
            raise FileNotFoundError(f"{self.path} has no stage {name}")
        if _SHARED in made:
            return self._spark.read.parquet(self._at(name, made[_SHARED]))
        used: dict[int, list[str]] = {}
        for dictionary, generation in made.items():
            if dictionary in state["dictionaries"]:
                used.setdefault(generation, []).append(dictionary)
        rows = None
        for generation, names in sorted(used.items()):
            part = self._spark.read.parquet(self._at(name, generation)).filter(F.array_contains(label_array(sorted(names)), F.col("dictionary")))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def _only(self, table: DataFrame, names: Sequence[str]) -> DataFrame:
        return table.filter(F.array_contains(label_array(sorted(names)), F.col("dictionary")))

    def run(self) -> bool:
        """Whether anything was run: a finished experiment is left alone unless overwritten, or
        refreshed with other dictionaries."""
        current = self._current()
        if current and not self.overwrite and self.finished() and current["settings"] == self._settings():
            marks = self._marks()
            if None not in marks and marks == current["marks"]:
                return False
        self._begin()
        if self.finished():
            return False
        state, conf = self._current(), self.conf
        everyone, changed = sorted(state["dictionaries"]), state["changed"]
        lexicon, exclusions = self.lexicon, self.exclusions
        valid = self._stage(
            "valid", lambda: valid_entries(self._only(self.entries, changed), lexicon, exclusions, conf.rules), changed
        )
        words = self._stage("words", lambda: word_counts(self._only(valid, changed)), changed)
        before = state["made"].get("terms", {}).get(_SHARED)
        terms = self._stage("terms", lambda: test_terms(words, conf.size, len(everyone), conf.seed), [_SHARED])
        dirty = self._decided("dataset", lambda: changed if before is not None and self._same_terms(before, terms) else everyone)
        self._stage("dataset", lambda: split_dataset(self._only(valid, dirty), terms, conf.seed), dirty, by="split")
        # the label set: one of the few things the driver has to know
        labels = sorted(r["label"] for r in self.dataset().select("label").distinct().collect())
        moved = self._current()["labels"] not in (None, labels)
        dirty = self._decided("model", lambda: everyone if moved else dirty)
        model = self._model(dirty, labels)
        test = self._only(self.split("test"), dirty)
        self._stage("test_scored", lambda: self.classifier.apply(test, model, ["word", "label"]), dirty)
        if conf.label_dictionaries:
            carry = [c for c in ("word", "quality") if c in self.entries.columns]
            own = self._only(self.entries, dirty)
            scored = self._stage("scored", lambda: self.classifier.apply(own, model, carry), dirty)
            self._stage("expanded", lambda: expand_lexicon(self._only(scored, dirty), lexicon, conf.label_threshold), dirty)
            self._stage("summary", lambda: self._summary(dirty), dirty)
        self._write_manifest(dirty, labels)
        return True

    def _decided(self, name: str, decide: Callable[[], Sequence[str]]) -> list[str]:
        """The dictionaries whose stages are made anew, decided once a generation and kept for a run that is taken up."""
        state = self._current()
        if name not in state["decided"]:
            self._keep({**state, "decided": {**state["decided"], name: list(decide())}})
        return self._current()["decided"][name]

    def _same_terms(self, generation: int, terms: DataFrame) -> bool:
        if generation == self._current()["generation"]:
            return False
        old = self._spark.read.parquet(self._at("terms", generation))
        return old.count() == terms.count() and not old.exceptAll(terms).head(1)

    def _model(self, dirty: Sequence[str], labels: list[str]) -> str:
        """The folder of the models of the dictionaries that are scored in this generation."""
        path = self._at("model", self._current()["generation"])
        if not path_exists(self._spark, f"{path}/_SUCCESS"):
            self.classifier.fit(self._only(self.split("train"), dirty), labels, path)
            write_text(self._spark, f"{path}/_SUCCESS", json.dumps({"labels": labels, "dictionaries": list(dirty)}))
        self._keep({**self._current(), "labels": labels})
        return path

    def _summary(self, names: Sequence[str]) -> DataFrame:
        fresh = best_confidence(unlabelled_positive(new_terms(self._only(self.scored(), names), self.lexicon)))
        train, test = self._only(self.split("train"), names), self._only(self.test_scored(), names)
        return run_summary(train, test, fresh, self.conf.report_threshold)

    def _write_manifest(self, dirty: Sequence[str], labels: list[str]) -> None:
        """The results, beside the stage they come from and in the manifest of the run."""
        state = self._current()
        results = {}
        if self.conf.label_dictionaries:
            results = {r["dictionary"]: r.asDict() for r in self.summary().collect()}  # one row per dictionary
            add_results(self._spark, self._at("summary", state["generation"]), {d: results[d] for d in dirty if d in results})
        stages = {n: {str(g): manifest_of(self._spark, self._at(n, g))["counts"] for g in sorted(set(m.values()))} for n, m in state["made"].items()}
        facts = {"conf": asdict(self.conf), "classifier": self.classifier.describe(), "labels": labels, "stages": stages, "results": results}
        write_text(self._spark, self._at("manifest.json"), json.dumps({**facts, "path": self.path, "generation": state["generation"]}, sort_keys=True))
        self._keep({**state, "finished": True, "changed": []})

    # --- what it made

    def manifest(self) -> dict:
        """Parameters, labels, counts of each stage and results of the run."""
        return json.loads(read_text(self._spark, self._at("manifest.json")))

    def dataset(self) -> DataFrame:
        return self._read("dataset")

    def split(self, name: str) -> DataFrame:
        return self.dataset().filter(F.col("split") == name).drop("split")

    def test_scored(self) -> DataFrame:
        return self._read("test_scored")

    def scored(self) -> DataFrame:
        return self._read("scored")

    def expanded(self) -> DataFrame:
        return self._read("expanded")

    def summary(self) -> DataFrame:
        return self._read("summary")

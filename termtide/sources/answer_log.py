"""Answers kept by a log of numbered commits.

Answers go to a folder of their own first; then a commit file of the next free number names that
folder. A number can be claimed once: of two writers at once one takes the next, and nothing is lost.
Readers list the commits and read their folders: a snapshot that later commits do not change. Of a key's
answers that of the later commit counts, whatever the clocks of the machines say; within one commit
the greater text. Compaction commits one folder for all commits up to a number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.session import local_table
from termtide.sources.files import create_once, names_in, read_text
from termtide.sources.observed import write_observed

_SCHEMA = "key string, value string"


@dataclass(frozen=True)
class Commit:
    number: int
    folder: str
    rows: int
    covers: int = 0  # a compaction stands for the commits up to this one


class AnswerLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def commits(self) -> list[Commit]:
        """All commits in order."""
        names = names_in(self.spark, f"{self.path}/commits")
        return [Commit(**json.loads(read_text(self.spark, f"{self.path}/commits/{n}"))) for n in names]

    def latest(self) -> int:
        names = names_in(self.spark, f"{self.path}/commits")
        return int(names[-1].split(".")[0]) if names else 0

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        folder = uuid.uuid4().hex
        facts = write_observed(rows, f"{self.path}/data/{folder}", {"log": self.path}, {"rows": F.count(F.lit(1))}, kind="json")
        return folder, facts["rows"]

    def _claim(self, folder: str, rows: int, covers: int = 0) -> int:
        number = self.latest() + 1
        while True:
            text = json.dumps({"number": number, "folder": folder, "rows": rows, "covers": covers})
            if create_once(self.spark, f"{self.path}/commits/{number:020d}.json", text):
                return number
            number += 1

    def append(self, answers: DataFrame) -> int:
        """Commits ``key, value`` and returns the number of the commit."""
        return self._claim(*self._write(answers.select("key", "value")))

    def snapshot(self, number: int | None = None) -> DataFrame:
        """``key, value`` as of a commit, by default the last one: one row per key."""
        commits = [c for c in self.commits() if number is None or c.number <= number]
        covered = max((c.covers for c in commits), default=0)
        # of compactions that cover the same the first; commits they stand for are left out
        whole = [c for c in commits if covered and c.covers == covered][:1]
        used = whole + [c for c in commits if not c.covers and c.number > covered]
        if not used:
            return local_table(self.spark, {"key": [], "value": []})
        rows = self.spark.read.json([f"{self.path}/data/{c.folder}" for c in used], schema=_SCHEMA)
        folder = F.regexp_extract(F.col("_metadata.file_path"), "/([0-9a-f]{32})/[^/]*$", 1)
        order = self.spark.createDataFrame([(c.folder, c.covers or c.number) for c in used], "_folder string, _number bigint")
        # one row per commit since the last compaction
        placed = rows.select("*", folder.alias("_folder")).join(F.broadcast(order), "_folder")
        return placed.groupBy("key").agg(F.max_by("value", F.struct("_number", "value")).alias("value"))

    def compact(self) -> int:
        """One folder for all there is; later snapshots read it and what was committed after."""
        covers = self.latest()
        if not covers:
            return 0
        return self._claim(*self._write(self.snapshot(covers)), covers)

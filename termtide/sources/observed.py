"""Outputs with a manifest beside them, counted in the pass that writes them."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termtide.session import path_exists
from termtide.sources.files import read_text, write_text

# Readers of the data pass over names that begin with an underscore.
MANIFEST = "_manifest.json"


class NoManifestError(FileNotFoundError):
    pass


def write_observed(
    df: DataFrame,
    path: str,
    conf: dict | None = None,
    counts: dict[str, Column] | None = None,
    *,
    kind: str = "parquet",
    overwrite: bool = False,
    partition_by: tuple[str, ...] = (),
    options: dict | None = None,
    results: dict | None = None,
) -> dict:
    """Writes ``df`` and, beside it, its manifest; returns the counts.

    ``counts`` are aggregates (``rows`` by default) observed while the rows are written, so that the
    output is not read again. The manifest holds the path, the format, the columns, the parameters
    ``conf``, the counts, and ``results`` known before. Lists among the counts are sorted.
    """
    spark = df.sparkSession
    seen = Observation()
    counted = df.observe(seen, *[c.alias(n) for n, c in (counts or {"rows": F.count(F.lit(1))}).items()])
    writer = counted.write.format(kind).mode("overwrite" if overwrite else "errorifexists").options(**(options or {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    facts = {k: sorted(v) if isinstance(v, list) else v for k, v in seen.get.items()}
    manifest = {
        "path": path,
        "format": kind,
        "columns": df.columns,
        "partition_by": list(partition_by),
        "conf": conf or {},
        "counts": facts,
        "results": results or {},
        "written": datetime.now(UTC).isoformat(),
    }
    write_text(spark, f"{path.rstrip('/')}/{MANIFEST}", json.dumps(manifest, sort_keys=True, default=str))
    return facts


def manifest_of(spark: SparkSession, path: str) -> dict:
    """What the manifest beside an output says."""
    file = f"{path.rstrip('/')}/{MANIFEST}"
    if not path_exists(spark, file):
        raise NoManifestError(file)
    return json.loads(read_text(spark, file))


def add_results(spark: SparkSession, path: str, results: dict) -> None:
    """Adds results that became known after the output was written."""
    manifest = manifest_of(spark, path)
    manifest["results"].update(results)
    write_text(spark, f"{path.rstrip('/')}/{MANIFEST}", json.dumps(manifest, sort_keys=True, default=str))

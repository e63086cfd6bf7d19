"""Session settings, shared scratch space and stage tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(
    master: str | None = None, app: str = "termtide", conf: dict | None = None
) -> SparkSession:
    """A session with the settings the jobs are written for.

    AQE sizes the shuffles and splits skewed join partitions; forcing the skew
    join lets it do so below an aggregate as well, at the price of one shuffle.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        # does without the Python call site of every column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, ``spark.checkpoint.dir``.

    A temporary folder stands in only in local mode, where it is seen by all
    tasks; on a cluster a missing setting is an error.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="termtide-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path, not yet existing, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation of the inputs,
    and gives the optimizer a true size for its broadcast decisions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, columns: dict[str, Iterable[str | None]]) -> DataFrame:
    """A small table of strings given in the program; its size is known to the optimizer."""
    arrays = {name: pa.array(list(values), pa.string()) for name, values in columns.items()}
    return spark.createDataFrame(pa.table(arrays))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application.

    Classes and functions that tasks import have to be found there, whatever folder the driver runs in.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="termtide-package-")) / "termtide_library.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, Path(package.name) / file.relative_to(package))
    context.addPyFile(str(bundle))
    _SHIPPED.add(context.applicationId)

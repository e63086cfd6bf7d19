"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the white space of the contracts: [\x20\x09-\x0D]
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column | str) -> Column:
    """A text, null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without_spaces(text: Column) -> Column:
    for char in SPACES:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array in one array, and where each value starts
    (one more offset than values). A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_size(batches: Iterator[pa.RecordBatch], name: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column ``name`` has about ``limit`` bytes in each; a longer value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_pieces(batch.column(name))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


# Rows of whole texts that are read, and that a Python worker is handed, at once.
TEXT_ROWS = 1000
_ROWS_AT_ONCE = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within reads texts, and hands them to Python, ``TEXT_ROWS`` at a time: a batch is held by the executor and by the worker."""
    before = {name: spark.conf.get(name) for name in _ROWS_AT_ONCE}
    more = {name: value for name, value in before.items() if not 0 < int(value) <= TEXT_ROWS}
    for name in more:
        spark.conf.set(name, str(TEXT_ROWS))
    try:
        yield
    finally:
        for name, value in more.items():
            spark.conf.set(name, value)


_MEMORY: dict[tuple, object] = {}


def remembered(name: tuple, make: Callable[[], object]):
    """What this worker has kept under ``name`` since earlier tasks, at first ``make()``; one memory at a time."""
    if name not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[name] = make()
    return _MEMORY[name]


def forget() -> None:
    """Empties the memory of earlier tasks. Workers outlive the stage that filled it, so stages without one call this."""
    if _MEMORY:
        _MEMORY.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Hands what is free back to the system. What the allocators keep for a next time would count beside the
    memory of the executor, of which a later stage may need more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of GNU has it
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` in a worker that keeps nothing of earlier tasks, nor afterwards of this one: it may idle beside others."""

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        forget()

    return tidy


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, unless they find it by their own path.

    Functions that run in tasks are imported there. A session started beside the
    package, or with it on ``PYTHONPATH``, has it; any other gets it as a zip file.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    roots = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if package.parent in roots or Path.cwd().resolve() == package.parent or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    folder = Path(tempfile.mkdtemp(prefix="termtide-package-"))
    with zipfile.ZipFile(folder / "termtide_package.zip", "w") as bundle:
        for file in package.rglob("*.py"):
            bundle.write(file, Path(package.name) / file.relative_to(package))
    context.addPyFile(str(folder / "termtide_package.zip"))


_SHIPPED: set[str] = set()

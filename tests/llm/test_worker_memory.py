"""What Python workers keep after their tasks."""

import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from termtide.llm import common, exact_dedup


def resident() -> int:
    """MB of this process."""
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads the process's memory from Linux")
def test_forgotten_memory_goes_back_to_the_system():
    before = resident()
    kept = common.remembered(("test", "blocks"), lambda: [bytes(100_000) + bytes([i % 251]) for i in range(4000)])
    top = [bytes(90_000) + b"x" for _ in range(20)]  # behind the others, so that the heap does not end at them
    full = resident()
    assert len(kept) == 4000 and full > before + 300
    del kept
    common.forget()
    assert len(top) == 20 and resident() < full - 250


def test_released_worker_keeps_nothing():
    seen = []

    def run(batches):
        common.remembered(("test", "run"), list).append(1)
        for batch in batches:
            seen.append(len(common._MEMORY))
            yield batch

    common.remembered(("test", "before"), dict)
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    assert list(common.released(run)(iter([batch]))) == [batch]
    assert seen == [1] and not common._MEMORY


def test_repeat_filter_takes_hashes_made_in_the_same_worker(spark):
    def halves(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy() // 2)], ["key"])

    rows, cells = spark.range(0, 1000, 1, 3), exact_dedup.cells_for(1000)
    made = exact_dedup.repeat_filter(rows, cells, of=halves)
    assert np.array_equal(made, exact_dedup.repeat_filter(rows.selectExpr("id div 2 as key"), cells)) and made.any()

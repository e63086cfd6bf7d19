"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a
comma-separated choice of queries. Each query is built and run to a sink that
drops the rows, once to warm up and then ``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from termtide.queries.catalog import QUERIES
from termtide.session import build_session

HEADLINE = [
    "join_label_exact",
    "join_label_prefix",
    "join_lookup_mapped",
    "anti_exclusions",
    "anti_new_terms",
    "join_answer_cache",
    "win_top_n_per_word",
    "win_best_quality",
    "win_last_wins",
    "win_pick_terms",
    "agg_label_counts",
    "agg_test_quota",
    "agg_class_report",
    "agg_threshold_curve",
    "agg_count_curve",
    "xf_compose_text",
    "xf_answer_labels",
    "xf_softmax_argmax",
    "src_lexicon_csv",
    "src_dictionary_votes",
    "job_valid_entries",
    "job_split_dataset",
    "job_expand_lexicon",
    "ml_train",
    "ml_apply",
    "ml_eval",
    "ml_encode_text",
    "ml_train_softmax",
    "ml_apply_softmax",
    "sort_permuted",
    "join_bucketed",
    "job_valid_entries_stream",
    "job_experiment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(min(8, os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",")
    names = [n for n in names if n] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        {
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    spark.stop()
    result = {
        "metric": "headline queries, warm, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Every query runs once to warm up, then BENCH_RUNS times; the median counts. Frozen baselines are forgotten before
every run, so that each time includes fitting them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "drift_report_simulated",
    "drift_run",
    "drift_processed",
    "contract_load_lineitem",
    "quality_report",
    "stratified_split",
    "stratified_folds",
    "classification_report",
    "cv_summary",
    "model_comparison",
    "feature_matrix",
    "linear_shap",
    "local_explanations",
    "global_importance",
    "drift_context",
    "alert_latest_state",
    "compact_parts",
    "stream_window_drift",
]


def main() -> None:
    from tidegauge.session import build_session
    from workload.common import forget_profiles
    from workload.registered import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            forget_profiles()
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "lineitem_rows": lineitem,
            }
        )
    )


if __name__ == "__main__":
    main()

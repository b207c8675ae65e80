"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelog.session import build_session  # noqa: E402

HEADLINE = [
    "window_report", "rate_expert", "candidate_bank", "matured_bank", "day_metrics", "comparison_table",
    "adaptive_window", "arw_daily", "correctness_ema", "softmax_ema", "hedge_discounted", "fixed_share", "learn_alpha",
    "global_blend", "diff_forgetting", "context_gate", "multi_gate", "adaptive_persistence", "simplex_mix",
    "block_tokens", "asof_history", "ops_block_predictions", "ons_stream", "anchored_share", "online_learner",
    "calibration_suite", "linear_frontier", "paced_auction", "paired_bootstrap", "rolling_origin", "nested_passes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("tidelog-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from tidelog.plans import catalog

    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # start the executors
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Wall seconds of the headline queries; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. A result is
written in full to the no-op sink, so nothing is left out by column or row pruning.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from flowscope.registry import queries

HEADLINE = [
    "scan_activity", "attack_timeline_ddos", "attack_timeline_spoofing", "infrastructure_impact",
    "inference_stats", "run_summary", "drop_markers", "scenario_t0",
    "counter_deltas", "counter_deltas_chunked", "flow_rates", "flow_features",
    "label_by_scenario", "label_by_scenario_long_log", "within_recording", "capture",
    "forwarding_decisions", "forwarding_decisions_chunked", "rule_worthy", "last_known_port",
    "live_devices", "clean", "encode_label", "stratified_split", "apply_scaler",
    "balanced_weights", "model_metrics", "confusion_matrix", "append_metrics",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            begin = time.monotonic()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.monotonic() - begin)
        seconds[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).lstrip("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores,
BENCH_RUNS the timed runs after one warm-up; the median run counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from hunkwise.plans.catalog import QUERIES
from hunkwise.session import build_session

HEADLINE = (
    "function_snippets",
    "snippet_bus_roundtrip",
    "token_vocab",
    "encode_pad",
    "score_linear",
    "score_batch",
    "repo_risk",
    "delivery_status",
    "placeholders_all",
    "enriched_snippets",
    "scored_snippets",
    "anomaly_stats",
    "latest_anomalies",
    "get_by_ids",
    "feed_search",
    "latency_percentiles",
    "latency_buckets",
    "classification_report",
    "roc_auc",
    "score_parity",
    "stream_scored_feed",
    "stream_latency_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    result = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

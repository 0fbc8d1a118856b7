"""Headline queries, each timed cold; prints one JSON line.

Shared frames are dropped before every query, so a time covers the scan, the clean
panel, and everything the query needs. Results go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "trend_exposure": "e29_timing_regime",
    "feature_panel": "h2_feature_panel",
    "lead_lag": "d8_lead_lag",
    "keyed_asof": "c3_keyed_asof",
    "episodes": "e26_surge_episodes",
    "rank_ic": "d30_rank_ic",
}


def main() -> None:
    from catalog import all_queries
    from catalog.registry import forget_contexts
    from panelkit.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executors
    times = {}
    for label, name in HEADLINE.items():
        forget_contexts()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[label] = round(time.perf_counter() - start, 3)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}
    print(json.dumps(out))


if __name__ == "__main__":
    main()

"""Times every query: one warm-up, then the median of the timed runs. Prints one JSON line.

Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_QUERIES (comma-separated names; all by default).
A query whose warm-up takes longer than BENCH_SLOW seconds is timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import catalog
from coverlens.session import local_session


def run_once(spark, query, sf: str) -> float:
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    slow = float(os.environ.get("BENCH_SLOW", "5"))
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = local_session("coverlens-bench", cpus, os.environ.get("BENCH_MEMORY", "12g"))
    seconds = {}
    for name, query in catalog.queries().items():
        if only and name not in only:
            continue
        timed = 1 if run_once(spark, query, sf) > slow else runs
        seconds[name] = round(statistics.median(run_once(spark, query, sf) for _ in range(timed)), 3)
        print(f"{name:36s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()

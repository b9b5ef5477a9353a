"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm the JVM and then twice into a sink that keeps nothing; the
better run counts. Reads and rule evaluation are all part of the time; nothing is cached.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from leadsieve.session import local_session  # noqa: E402

HEADLINE = (
    "audit_queue",
    "base_open_funnel",
    "latest_stage",
    "loop_counts",
    "join_calls",
    "categorise",
    "lrm_category_rank",
    "rules_v7",
    "rules_v3",
    "rules_v1",
    "rule_migration",
    "rca_latest",
    "recording_inventory",
    "phone_match_probe",
    "value_census",
)


def run(frame) -> float:
    start = time.perf_counter()
    frame().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("leadsieve-bench", cores=cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds = {}
    for name in HEADLINE:
        times = [run(lambda: queries[name](spark, sf_dir)) for _ in range(3)]
        seconds[name] = round(min(times[1:]), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Every query is
run once to warm up and then five times to the last row through a no-op sink; the median counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from rowmill.catalog import QUERIES
from rowmill.session import build_session

RUNS = 5
HEADLINE = (
    "validate_contacts",
    "validation_by_code",
    "security_scan_documents",
    "dedup_keep_first",
    "dedup_verdicts",
    "dup_histogram",
    "chunk_assign",
    "chunk_meta",
    "bulk_update",
    "update_outcomes",
    "upsert_update",
    "upsert_state_update",
    "patch_update",
    "action_rates",
    "increment_counters",
    "action_overview",
    "latency_objectives",
    "running_means",
    "rate_limit_sliding",
    "rate_limit_session",
    "status_transitions",
    "list_actions_page",
    "csv_roundtrip",
    "flow_statistics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

Each query is run once to warm up and then timed; the result is written to the
``noop`` sink, so every row is produced and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from cubeloom.session import local_session
from cubeloom.suite import all_queries

HEADLINE = [
    "hierarchy_rollup",
    "hierarchy_rollup_deep",
    "join_dim_level",
    "join_typed",
    "cross_cube_join",
    "range_join",
    "ancestor_closure",
    "derive_parents",
    "process_fact",
    "clean_measure",
    "period_to_date",
    "pick_periods",
    "apply_delta",
    "delta_report",
    "monthly_revenue",
    "top_products",
    "pivot_bands",
    "pin_totals",
    "conditional_share",
    "latest_with_change",
    "percent_of_base",
    "densify_cube",
    "param_query",
    "write_periods",
    "read_periods",
    "table_profile",
    "fuzzy_lookup",
    "post_once",
    "accepted_credits",
    "trace_events",
    "turn_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="cubeloom-bench")
    known = all_queries()
    wanted = list(known) if names == "all" else names.split(",") if names else HEADLINE
    timings: dict[str, float] = {}
    for name in wanted:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()

"""Wall time of the headline queries at one scale; prints one JSON line.

BENCH_SF_DIR  folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_ONLY    comma-separated query names, for a part of the list
BENCH_RUNS    timed runs per query, the best counts (default 1)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideway.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = [
    "min_slice_split_score",
    "a01_bucket_mean",
    "a10_quantile",
    "a17_bin_mean",
    "w02_lead",
    "w03_global_ids",
    "j03_star_join",
    "j15_neighbor_join",
    "d14_depth_class",
    "d16_expand_neighbors",
    "d21_contrasts",
    "d24_normalise",
    "d25_augment",
    "d27_network_score",
    "d28_choice_probability",
    "d31_decision_score",
    "d32_compare_models",
    "d39_state_space",
    "d40_transition_table",
    "d41_propagate",
    "d42_grid_environment",
    "d43_mean_by_cell",
    "d47_fit_tabular_odds",
    "d_movement_choices",
    "d_depth_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session(
        "tideway-bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executors and load the common classes before timing; nothing is kept.
    QUERIES["a03_group_count"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["j01_equi_join"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

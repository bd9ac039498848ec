"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortspark.plans import callables  # noqa: E402
from cohortspark.session import local_session  # noqa: E402

HEADLINE = [
    "scan_encounters", "scan_flowsheets", "join_interval_between", "join_asof_last", "join_multi_key_fanin", "join_relative_window",
    "agg_generic", "agg_regular_windows", "agg_describe", "agg_category_distribution", "agg_weekly_rate", "window_latest_row",
    "window_nth_distinct", "window_row_number", "profile_table_details", "concept_flag", "str_clean", "str_regex_first",
    "cat_race_consolidate", "num_growth_percentile", "cohort_infection_in_pregnancy", "cohort_exposure_state", "cohort_breakthrough",
    "feature_condition_status", "feature_medication_counts", "feature_severity_daily", "surv_censor_frame", "surv_kaplan_meier",
    "stat_mann_whitney", "stat_chi_square", "stat_protection_rate", "stat_fisher_2x2", "match_caliper_1to1",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = callables()
    if keys == ["all"]:
        keys = list(queries)
    times: dict[str, float] = {}
    for key in keys:
        seen = []
        for _ in range(runs + 1 if runs > 1 else 1):
            start = time.perf_counter()
            queries[key](spark, folder).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        measured = sorted(seen[1:] or seen)
        times[key] = round(measured[len(measured) // 2 if len(measured) % 2 else len(measured) // 2 - 1], 3)
        print(f"{key} {times[key]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

"""Wall time of registered queries: one warm-up run and the median of the timed runs, results written nowhere.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_REPEAT (timed runs), BENCH_QUERIES ("headline",
"all" or comma-separated names). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from grainmill.session import clear_scratch, local_session
from grainmill.workloads import QUERIES, load_all

HEADLINE = (
    "fa01_return_statistics", "fa05_alpha_beta", "fa07_scorecard", "fa11_value_at_risk", "fa12_rolling_sharpe",
    "fa13_cohorts", "fa14_plan_continuity", "fa15_concentration", "fa16_recommend_high",
    "q02_monthly_average", "q04_by_state_and_type", "q10_distinct_and_total", "i05_key_match", "i10_date_dimension",
    "a02_sum_avg_count", "a07_quantile_list", "a13_pivot_sum", "a19_correlation_matrix", "a20_dedup_keep_first",
    "j10_similar_value_pairs", "w05_average_rank",
    "c03_fill_median", "c04_forward_fill", "c05_remove_duplicates", "c11_standardize_dates", "c12_convert_numeric",
    "c21_outliers_capped", "c40_run_plan",
    "d03_duplicate_rows", "d04_near_duplicates", "d08_outliers", "d19_url_pattern", "d22_health_score",
    "p02_column_report", "n15_full_inspection", "e02_numeric_profile", "e04_datetime_profile",
    "h04_customer_concentration", "b03_busy_weeks", "b06_slow_and_fast_movers", "t01_cell_changes",
    "l03_statistics_by_setting", "l13_anova", "z01_day_metrics", "z04_mean_drift", "x01_squeeze_documents",
)


def chosen() -> list[str]:
    wanted = os.environ.get("BENCH_QUERIES", "headline")
    if wanted == "headline":
        return list(HEADLINE)
    if wanted == "all":
        return list(QUERIES)
    return [name.strip() for name in wanted.split(",")]


def main() -> None:
    load_all()
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in chosen():
        try:
            run(name)
            seconds[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
        except Exception as error:  # noqa: BLE001 - one broken query must not hide the others
            print(f"{name}: {error}", file=sys.stderr)
            seconds[name] = None
        clear_scratch(spark)
    total = sum(s for s in seconds.values() if s is not None)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(total, 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

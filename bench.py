"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and
``BENCH_QUERIES`` (comma-separated names, or ``all``) select data, cores and queries.
Every query is run to its last row, without keeping the result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glycospan.session import get_session  # noqa: E402

HEADLINE = (
    "s2_table_statistics",
    "s3_column_profile",
    "q3_deltas",
    "q6_anomaly_labels",
    "q8_anomaly_counts_per_user",
    "c2_winsorized",
    "c3_hourly_grid",
    "c4_hourly_interpolated",
    "c4_hourly_interpolated_per_user",
    "f6_features",
    "f6_features_per_user",
    "f10_standard_scaling",
    "p1_hour_profile",
    "p3_peak_hours",
    "p4_linear_trend",
    "p6_distribution_per_user",
    "p7_time_in_range_per_user",
    "p8_histogram",
    "p13_compare_horizons",
    "p16_kpi_row",
    "m1_seasonal_trend",
    "m1_fourier_trend",
    "m2_linear_regression",
    "m3_ridge_per_patient",
    "m5_random_forest",
    "m5_random_forest_per_patient",
    "m6_gradient_boosting",
    "m7_second_order_boosting_per_patient",
    "m8_kernel_regression",
    "m8_exact_kernel_regression",
    "m9_nearest_neighbours",
    "m10_decision_tree",
    "m10_decision_tree_per_patient",
    "x2_recursive_forecast",
    "x2_recursive_forest",
    "x3_frozen_forecast",
    "x8_date_range_forecast",
    "e2_error_metrics",
    "e4_leaderboard",
    "r5_report_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from oracle.registry import QUERIES

    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else list(HEADLINE)
    QUERIES["s6_load_summary"](spark, sf_dir).count()  # start the JVM side
    timings = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {timings[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

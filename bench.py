"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload import QUERIES, Tables  # noqa: E402

HEADLINE = (
    "sql_group_by",
    "sql_inner_join",
    "sql_row_number",
    "sql_deviation_from_mean",
    "grid_filter_conjunction",
    "grid_search_all_columns",
    "chart_top_groups_by_sum",
    "chart_median",
    "table_quality",
    "profile_numeric_core",
    "profile_numeric_shape",
    "profile_text",
    "column_stats_numeric",
    "compare_shared_columns",
    "all_string_steps",
    "coerce_numbers_and_booleans",
    "dedup_keep_first",
    "dedup_subset_of_columns",
    "outliers_iqr_cap",
    "outliers_modified_z_replace_median",
    "impute_median",
    "impute_most_frequent",
    "forward_fill",
    "impute_nearest_neighbours",
    "impute_chained_ridge",
    "anomaly_flags",
    "correlation_matrix",
    "explained_variance_of_two_columns",
    "clean_with_iqr_cap_and_median",
)
RUNS = 2


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    tables = Tables(spark, folder)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name].run(tables).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": f"sum of the better of {RUNS} runs of {len(seconds)} queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

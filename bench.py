"""Time the headline queries; prints one JSON line.

Every run builds its plan anew and writes the whole result to a no-op sink,
so nothing is cached between runs and nothing is skipped.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.queries import ALL  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINES = (
    "r_clean_revenue",
    "i_infer_types",
    "p_number",
    "p_top_values",
    "d_duplicate_rows",
    "d_category_mapping",
    "d_all",
    "q_page",
    "a_sum",
    "a_distinct",
    "t_parse_dates",
    "t_dedup_all",
    "t_fill_median",
    "t_fill_forward",
    "r_diff_map",
    "r_diff_join",
)


def timed(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    ALL[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # Equal code then compiles once, whatever its place in the plan.
        .config("spark.sql.codegen.useIdInClassName", "false")
        # Small shuffles still use all cores: cells cost time, not bytes.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        timed(spark, name)
        seconds[name] = round(statistics.median(timed(spark, name) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "master": f"local[{CPUS}]",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

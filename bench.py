"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
local threads. Each query is written to Spark's noop sink, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from refrain.plans.queries import QUERIES

HEADLINE = (
    "agg1_recurring_windows",
    "win1_rolling_hash",
    "win1_rolling_hash_u64",
    "win3_analysis_vector",
    "win7_sessions",
    "jn2_landmark_matches",
    "jn3_regions",
    "jn4_hamming_bands",
    "jn5_hamming_blocks",
    "jn12_full_duplicates",
    "int1_islands",
    "int7_keeps",
    "detx5_cut_plan",
    "deta5_spectral_hash",
    "deta1_chromaprint",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["int1_islands"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time every registered query on $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from vulnlake.catalog import QUERIES

# one query per heavy plan shape; BENCH_ALL=1 runs the whole catalogue
HEADLINE = [
    "job_09_commit_frequency", "joi_07_method_frequency", "joi_06_single_line_fixes", "joi_09_side_by_side",
    "joi_10_injection_fixes_javascript", "joi_12_time_window_candidates", "joi_14_twin_window",
    "joi_21_commits_with_twins", "joi_22_similar_documents", "joi_11_changed_methods", "win_01_one_commit_per_hash",
    "win_04_one_method_per_key", "snk_03_insert_ignore", "srt_03_nearest_candidates", "lnk_01_best_link",
    "lnk_18_fixing_commits", "agg_07_relevance", "agg_09_value_summary", "exp_03_cpe_names", "fun_09_relevant_words",
    "exp_07_diff_lines", "job_06_ranked_candidates",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

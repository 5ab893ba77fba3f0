"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from skein import catalog

HEADLINE = (
    "grep_literal", "grep_literal_all", "grep_regex", "grep_count_by_file", "grep_context", "multi_grep_matched_patterns", "grep_through_index", "scan_same_literal", "filter_glob", "find_scored_tokens",
    "find_by_frecency", "find_fuzzy", "frecency_access_score", "combo_runs", "language_stats", "tree_rollup", "top_symbols", "token_semi_join", "refs_tokens", "impact_rank", "did_you_mean", "token_budget",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").count()  # starts the session before anything is timed
    took = {}
    began = time.perf_counter()
    catalog.saved_postings(spark, sf)
    build = round(time.perf_counter() - began, 3)  # once for a corpus, so apart from the queries
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "index_build": build, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

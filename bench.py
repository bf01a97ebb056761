"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the input and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from veridex.plans.registry import QUERIES

HEADLINE = ("trial_rank", "criterion_verdicts", "routing_cascade", "run_summary", "blocking_list", "resume_todo", "tokenize_terms", "bm25_corpus_stats", "bm25_topk", "dense_topk", "hybrid_search", "clean_text", "report_rows", "topk_per_group")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["criterion_verdicts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

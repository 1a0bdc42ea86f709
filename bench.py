"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the first query once to warm up, then the median of $BENCH_RUNS runs (1) of each. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = ["concept_match", "concept_search_topk", "hybrid_search", "vector_topk", "batch_vector_topk", "token_counts", "tfidf_weights", "bm25_weights", "hash_embedding_sparse", "chunk_text", "html_strip", "log_trace_group", "log_level_extract", "cooccurrence_pairs"]
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lexispark.plans.queries import QUERIES

    found = {}
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

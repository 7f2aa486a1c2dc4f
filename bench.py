"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

import workload

HEADLINE = [
    "dataset_build", "prompt_batch", "training_pairs", "training_pairs_exact_split",
    "f1_dedup_first", "f2_sample_per_group", "f4_stratified", "a7_cap_per_key",
    "e1_judge_summary", "e2_diversity_summary", "e8_top_words", "e10_classification_report",
    "e12_roc_auc", "e16_numbered_block", "e18_verdict_rates", "g3_ngrams", "h1_embed", "h4_tfidf",
    "h6_linear_score", "e14_contributions", "d7_knn_realism", "d8_knn_self_similarity",
    "d8_knn_self_similarity_cells", "d10_overlap_pairs", "g15_audit_hallucination", "h7_fit_eval",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        workload.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

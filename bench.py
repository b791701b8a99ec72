"""Headline operators at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import catalog  # noqa: E402
from catalog import base  # noqa: E402
from sorrel.plans.staging import release  # noqa: E402

HEADLINE = [
    "token_ngrams", "char_ngrams", "build_vocabulary", "weight_tfidf", "information_gain", "rank_by_su", "label_correlation",
    "feature_correlation", "balance_many_labels", "naive_bayes", "cross_validate", "label_performance", "ranked_outcomes",
    "knn_neighbours",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    # The word counts are the input of most queries and are timed apart.
    start = time.perf_counter()
    base.words(spark, sf)
    times["word_counts"] = round(time.perf_counter() - start, 3)
    base.folds(spark, sf)
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    release(spark)
    spark.stop()
    print(json.dumps({
        "metric": "wall seconds of the headline operators", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()

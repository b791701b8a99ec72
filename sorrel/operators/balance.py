"""Equal label counts by whole copies and seeded remainders."""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame, functions as F

from sorrel.functions.hashing import hash_key
from sorrel.plans.staging import rank_within

# Copies of one row that one task makes at a time.
CHUNK = 10_000


def balance(labels: DataFrame, seed: int = 42, target: str = "auto") -> DataFrame:
    """``(doc_id, copy, label)`` with the same number of rows per label.

    The target is the mean of the counts for two labels, the median for more,
    and the smallest count with ``target='min'``.  Rows are ranked inside their
    label through one global range sort, so a label that holds most of the
    documents is spread over many tasks.
    """
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sizes = sorted(counts.values())
    if target == "min":
        goal = sizes[0] if sizes else 0
    elif len(sizes) == 2:
        goal = int(sum(sizes) / 2)
    else:
        goal = int(statistics.median(sizes)) if sizes else 0

    keyed = labels.select("doc_id", "label", hash_key(seed, F.col("doc_id")).alias("_h"))
    ranked = rank_within(keyed, ["label"], [F.col("_h").asc(), F.col("doc_id").asc()], "_r")
    kind = labels.schema["label"].dataType.simpleString()
    table = labels.sparkSession.createDataFrame(list(counts.items()), f"label {kind}, _n long")
    ranked = ranked.join(F.broadcast(table), "label")
    whole = F.floor(F.lit(goal) / F.col("_n"))
    extra = (F.col("_r") <= F.lit(goal) % F.col("_n")).cast("long")
    rows = ranked.select("doc_id", "label", (whole + extra).cast("long").alias("_k")).filter("_k > 0")

    most = max((goal // n + 1 for n in sizes), default=0)
    if most > CHUNK:
        rows = rows.select("doc_id", "label", "_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_k") - 1) / CHUNK))).alias("_c"))
        rows = rows.repartition("doc_id", "_c")
    else:
        rows = rows.withColumn("_c", F.lit(0).cast("long"))
    first = F.col("_c") * CHUNK
    last = F.least(first + CHUNK, F.col("_k")) - 1
    return rows.select("doc_id", F.explode(F.sequence(first, last)).alias("copy"), "label")


def balance_features(features: DataFrame, copies: DataFrame) -> DataFrame:
    """Features of every balanced row under the key ``(doc_id, copy)``."""
    return features.join(copies.select("doc_id", "copy"), "doc_id")

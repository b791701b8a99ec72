"""Multiclass perceptron by iterative parameter mixing (McDonald et al. 2010)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sorrel.functions.hashing import hash_key
from sorrel.operators.instances import in_order
from sorrel.plans.staging import stage


@dataclass
class Perceptron:
    labels: list
    weights: np.ndarray  # labels x (features + 1), the last column is the bias

    def scores(self, vectors: DataFrame, docs: DataFrame) -> DataFrame:
        """Probability 1.0 for the label with the largest margin."""
        k, size = len(self.labels), self.weights.shape[1] - 1
        rows = [(j, [float(v) for v in self.weights[:, j]]) for j in range(size) if self.weights[:, j].any()]
        table = docs.sparkSession.createDataFrame(rows, "feature_id int, w array<double>")
        joined = vectors.join(F.broadcast(table), "feature_id")
        sums = joined.groupBy("doc_id").agg(*[F.sum(F.col("value") * F.col("w")[i]).alias(f"_{i}") for i in range(k)])
        bias = [float(v) for v in self.weights[:, size]]
        margin = F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0.0)) + F.lit(bias[i]) for i in range(k)])
        every = docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", margin.alias("_m"))
        best = F.array_position("_m", F.array_max("_m"))
        every = every.select("doc_id", best.alias("_b"))
        cells = F.array(*[
            F.struct(F.lit(v).alias("label"), (F.col("_b") == i + 1).cast("double").alias("prob")) for i, v in enumerate(self.labels)
        ])
        return every.select("doc_id", F.explode(cells).alias("c")).select("doc_id", "c.label", "c.prob")


def fit_perceptron(
    vectors: DataFrame,
    labels: DataFrame,
    size: int,
    iterations: int = 10,
    shard_rows: int = 10_000,
    seed: int = 42,
    alpha: float = 0.0001,
    penalty: str | None = None,
) -> Perceptron:
    """Each shard runs one pass from the shared weights; the shards' means follow.

    Documents are dealt to shards of about ``shard_rows`` by a hash of their id and
    passed in the order of another hash, so neither the packing of files nor the
    number of partitions changes the result.  ``alpha`` is the strength of
    ``penalty`` (``l2``, or none): every step shrinks the weights by that share.  The
    driver holds labels x selected features weights, never documents.
    """
    if penalty not in (None, "l2"):
        raise ValueError(f"unknown penalty: {penalty}")
    order = in_order(r["label"] for r in labels.select("label").distinct().collect())
    shards = max(1, -(-labels.count() // shard_rows))
    decay = 1.0 - alpha if penalty == "l2" else 1.0
    key = ["doc_id", "copy"] if "copy" in labels.columns else ["doc_id"]
    pair = F.collect_list(F.struct(F.col("feature_id").cast("int").alias("i"), "value"))
    code = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("label")) - 1
    rows = labels.withColumn("code", code).join(vectors.groupBy(*key).agg(pair.alias("_p")), key, "left")
    shard = F.conv(F.substring(hash_key(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long") % shards
    rows = rows.select(
        "code",
        shard.alias("shard"),
        hash_key(seed + 1, F.col("doc_id")).alias("at"),
        F.coalesce(F.transform("_p", lambda x: x["i"]), F.array().cast("array<int>")).alias("ids"),
        F.coalesce(F.transform("_p", lambda x: x["value"]), F.array().cast("array<double>")).alias("vals"),
    )
    rows = stage(rows, "shards")
    k = len(order)
    weights = np.zeros((k, size + 1))
    for _ in range(iterations):
        start = weights

        def train(pdf):
            w = start.copy()
            pdf = pdf.sort_values(["at", "code"], kind="stable")
            for target, ids, vals in zip(pdf["code"], pdf["ids"], pdf["vals"]):
                # One machine per label: wrong side of its margin, then a step.
                at = np.append(np.asarray(ids, np.int64), size)
                x = np.append(np.asarray(vals, float), 1.0)
                sign = np.where(np.arange(k) == target, 1.0, -1.0)
                wrong = sign * (w[:, at] @ x) <= 0
                if decay != 1.0:
                    w[:, :size] *= decay
                if wrong.any():
                    w[np.ix_(wrong, at)] += np.outer(sign[wrong], x)
            code, feature = np.nonzero(w)
            return pd.DataFrame({"code": np.append(code, -1), "feature_id": np.append(feature, -1), "w": np.append(w[code, feature], 1.0)})

        mixed = rows.groupBy("shard").applyInPandas(train, "code long, feature_id long, w double")
        parts = mixed.groupBy("code", "feature_id").agg(F.sum("w").alias("w")).collect()
        count = next((r["w"] for r in parts if r["code"] < 0), 1.0)
        weights = np.zeros((k, size + 1))
        for r in parts:
            if r["code"] >= 0:
                weights[r["code"], r["feature_id"]] = r["w"] / count
        if np.allclose(weights, start):
            break
    return Perceptron(order, weights)

"""Random baseline: labels drawn by a seeded hash of the document id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sorrel.functions.hashing import hash_unit
from sorrel.operators.instances import in_order


def random_baseline(docs: DataFrame, labels: DataFrame, mode: str = "equal", seed: int = 42) -> DataFrame:
    """``(doc_id, prediction)``, uniform (``equal``) or by label share (``weighted``).

    The cumulative shares are one short array, which each row searches for its
    own draw.
    """
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = in_order(counts)
    total, seen, edges = sum(counts.values()), 0, []
    for i, label in enumerate(order):
        seen += counts[label]
        edges.append((i + 1) / len(order) if mode == "equal" else seen / total)
    bins = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(v).alias("v")) for e, v in zip(edges, order)])
    draw = hash_unit(seed, F.col("doc_id"))
    return docs.select("doc_id", draw.alias("_u")).select(
        "doc_id", F.filter(bins, lambda b: F.col("_u") < b["e"])[0]["v"].alias("prediction")
    )

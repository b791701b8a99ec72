"""Numeric predictions turned into ordinal or nominal labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def nearest_ordinal(numeric: DataFrame) -> DataFrame:
    """Numeric prediction cast to an integer label."""
    return numeric.select("doc_id", F.col("prediction").cast("int").alias("prediction"))


def label_ranges(train: DataFrame) -> DataFrame:
    """``(label, lower, upper)`` from ``train(label, label_num)``.

    Labels are ordered by their smallest value; an interval reaches from the
    previous label's largest value to its own, open at both outer ends.
    """
    span = train.groupBy("label").agg(F.min("label_num").alias("lo"), F.max("label_num").alias("hi"))
    # One row per label.
    order = Window.orderBy("lo", "hi", "label")
    inf = float("inf")
    last = F.lead("label").over(order).isNull()
    return span.select(
        "label",
        F.coalesce(F.lag("hi").over(order), F.lit(-inf)).cast("double").alias("lower"),
        F.when(last, F.lit(inf)).otherwise(F.col("hi")).cast("double").alias("upper"),
        F.row_number().over(order).alias("place"),
    )


def translate_numeric(numeric: DataFrame, train: DataFrame) -> DataFrame:
    """``(doc_id, prediction)``: the label whose interval holds the number.

    The edges are a short sorted array, so each row looks its label up by
    itself.  Overlapping intervals go to the first label in order.
    """
    edges = [
        (r["label"], r["lower"], r["upper"]) for r in label_ranges(train).orderBy("place").collect()
    ]
    bins = F.array(*[
        F.struct(F.lit(v).alias("label"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for v, lo, hi in edges
    ])
    x = F.col("prediction").cast("double")
    holds = F.filter(bins, lambda b: (x > b["lo"]) & (x <= b["hi"]))
    return numeric.select("doc_id", F.col("prediction").alias("number"), holds[0]["label"].alias("prediction"))

"""Per-feature scaling to a fixed interval, fitted on the train documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sorrel.operators.ngrams import KEY
from sorrel.plans.staging import fits, skew_join, stage


def _names(features: DataFrame) -> list[str]:
    return [*KEY, "feature_id"] if "feature_id" in features.columns else list(KEY)


def fit_minmax(features: DataFrame, n_docs: int) -> DataFrame:
    """``(ftype, feature, feature_id?, df, lo, hi)``; implied zeros count as values."""
    per = features.groupBy(*_names(features)).agg(
        F.count("*").alias("df"), F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    sparse = F.col("df") < F.lit(n_docs)
    return per.select(
        *_names(features),
        "df",
        F.when(sparse, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo")).alias("lo"),
        F.when(sparse, F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi")).alias("hi"),
    )


def apply_minmax(features: DataFrame, scaler: DataFrame, docs: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Scale to ``[lo, hi]``; features that the scaler does not know are dropped.

    Documents may be told apart by further columns, such as ``copy``, that
    ``docs`` has too.  Where zero maps to zero the table stays sparse.  A feature
    whose zero maps elsewhere has a value in every document; those rows are made
    for these features only.  Each document lists them once and the ones that it
    lacks are added by the sum of both tables, so nothing is collected.  The list
    is one row, a column of the dense result; a list too long to be sent to the
    tasks is an error, since the dense result could not be written either.
    """
    scaler = stage(scaler, "scaler")
    names = _names(scaler)
    ids = [c for c in features.columns if c not in (*names, "feature_id", "value")]
    span = F.col("hi") - F.col("lo")
    # A constant feature has span 1, as it maps to the lower bound.
    width = F.when(span == 0, F.lit(1.0)).otherwise(span)
    scaled = lambda x: (x - F.col("lo")) / width * F.lit(float(hi - lo)) + F.lit(float(lo))
    known = skew_join(features.select(*ids, *KEY, "value"), scaler, KEY)
    rows = known.select(*ids, *names, scaled(F.col("value")).alias("value"))

    moved = stage(scaler.select(*names, scaled(F.lit(0.0)).alias("zero")).filter(F.col("zero") != 0), "moved")
    if not moved.isEmpty():
        if not fits(moved):
            raise ValueError("too many features whose zero moves: prune them first")
        every = moved.agg(F.collect_list(F.struct(*names, "zero")).alias("z"))
        base = docs.select(*ids).crossJoin(F.broadcast(every)).select(*ids, F.explode("z").alias("z"))
        base = base.select(*ids, *(f"z.{c}" for c in names), F.lit(None).cast("double").alias("value"), "z.zero")
        both = rows.withColumn("zero", F.lit(None).cast("double")).unionByName(base)
        rows = both.groupBy(*ids, *names).agg(F.coalesce(F.max("value"), F.max("zero")).alias("value"))
    return rows.filter(F.col("value") != 0)

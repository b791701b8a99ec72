"""Evaluation tables: per label, pooled, ordinal, top-k, per document, per fold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sorrel.functions.stats import ratio
from sorrel.operators.instances import predictions as best_label
from sorrel.plans.staging import rank_within

METRICS = ["pr", "re", "f1", "tpr", "fpr", "auc", "tot", "clf", "cor"]


def outcomes(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """``(doc_id[, fold], target, prediction)``."""
    return predictions.join(targets.select("doc_id", F.col("label").alias("target")), "doc_id")


def confusion_matrix(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per (target, prediction)."""
    return pairs.groupBy(*(by or []), "target", "prediction").agg(F.count("*").alias("n"))


def confusion_pivot(pairs: DataFrame, labels: list) -> DataFrame:
    """One column per predicted label."""
    return pairs.groupBy("target").pivot("prediction", labels).count().fillna(0)


def _cells(matrix: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn per label from the small confusion table."""
    hit = F.when(F.col("target") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("target").alias("label"), F.col("n").alias("tot"), zero.alias("clf"), hit.cast("long").alias("cor")),
        F.struct(F.col("prediction").alias("label"), zero.alias("tot"), F.col("n").alias("clf"), zero.alias("cor")),
    )
    rows = matrix.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    sums = rows.groupBy(*by, "label").agg(F.sum("tot").alias("tot"), F.sum("clf").alias("clf"), F.sum("cor").alias("cor"))
    # One row per label here, so the window holds no more than the labels.
    n = F.sum("tot").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    sums = sums.withColumn("n", n)
    return sums.select(
        *by, "label", "n", "tot", "clf", F.col("cor").alias("tp"), (F.col("clf") - F.col("cor")).alias("fp"),
        (F.col("tot") - F.col("cor")).alias("fn"), (F.col("n") - F.col("tot") - F.col("clf") + F.col("cor")).alias("tn"),
    )


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    pr, re = ratio(tp, tp + fp), ratio(tp, tp + fn)
    fpr = ratio(fp, fp + tn)
    return {
        "pr": pr, "re": re, "f1": ratio(2 * tp, 2 * tp + fp + fn), "tpr": re, "fpr": fpr,
        "auc": (F.lit(1.0) + re - fpr) / 2,
    }


def _rates():
    return [v.alias(k) for k, v in rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).items()]


def label_performance(pairs: DataFrame, labels: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Rates and counts per label; a label of ``labels`` never seen gets zeros."""
    by = by or []
    cells = _cells(confusion_matrix(pairs, by), by)
    out = cells.select(*by, "label", *_rates(), "tot", "clf", F.col("tp").alias("cor"))
    if labels is not None and not by:
        out = labels.select("label").distinct().join(out, "label", "full").fillna(0, METRICS)
    return out


def micro_from_matrix(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Rates over the pooled cells of all labels, from confusion counts."""
    cells = _cells(matrix, by)
    pooled = cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.max("n").alias("tot"))
    return pooled.select(*by, F.lit("micro").alias("label"), *_rates(), "tot", F.col("tot").alias("clf"), F.col("tp").alias("cor"))


def micro_performance(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return micro_from_matrix(confusion_matrix(pairs, by), by or [])


def performance(pairs: DataFrame, labels: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Label rows and the pooled row."""
    per = label_performance(pairs, labels, by)
    per = per.withColumn("label", F.col("label").cast("string"))
    return per.unionByName(micro_performance(pairs, by))


def ordinal_performance(pairs: DataFrame) -> DataFrame:
    """Label rates plus MAE, RMSE and accuracy, per target label and overall."""
    pairs = pairs.select(F.col("target").cast("int").alias("target"), F.col("prediction").cast("int").alias("prediction"))
    matrix = confusion_matrix(pairs)
    cells = _cells(matrix, [])
    diff = (F.col("target") - F.col("prediction")).cast("double")
    errors = matrix.rollup("target").agg(
        F.sum(F.abs(diff) * F.col("n")).alias("ae"), F.sum(diff * diff * F.col("n")).alias("se"), F.sum("n").alias("m")
    )
    errors = errors.select(
        F.coalesce(F.col("target").cast("string"), F.lit("overall")).alias("label"),
        (F.col("ae") / F.col("m")).alias("mae"), F.sqrt(F.col("se") / F.col("m")).alias("rmse"),
    )
    count = F.col("n").cast("double")
    per = cells.select(F.col("label").cast("string").alias("label"), *_rates(), ((F.col("tp") + F.col("tn")) / count).alias("acc"), "tot", "clf", F.col("tp").alias("cor"))
    pooled = micro_performance(pairs).withColumn("label", F.lit("overall")).withColumn("acc", F.col("cor") / F.col("tot"))
    rows = per.unionByName(pooled).join(errors, "label", "left").fillna(0.0, ["mae", "rmse"])
    return rows.select("label", "pr", "re", "f1", "tpr", "fpr", "auc", "mae", "rmse", "acc", "tot", "clf", "cor")


def pairs_at_k(scores: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """``(doc_id, target, prediction)`` where a target in the top ``k`` is a hit."""
    order = Window.partitionBy("doc_id").orderBy(F.col("prob").desc(), F.col("label").asc())
    ranked = scores.select("doc_id", "label", F.row_number().over(order).alias("r")).filter(F.col("r") <= k)
    near = F.collect_set("label").alias("near")
    first = F.min(F.struct("r", "label"))["label"].alias("prediction")
    pairs = outcomes(ranked.groupBy("doc_id").agg(near, first), targets)
    hit = F.array_contains("near", F.col("target"))
    return pairs.select("doc_id", "target", F.when(hit, F.col("target")).otherwise(F.col("prediction")).alias("prediction"))


def performance_at_k(scores: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    return performance(pairs_at_k(scores, targets, k))


def allowed_ks(n_labels: int) -> list[int]:
    """Which of 3, 5, 7, 9 the number of labels permits."""
    return [k for k in (3, 5, 7, 9) if n_labels >= k]


def doc_predictions(scores: DataFrame, targets: DataFrame, labels: list) -> DataFrame:
    """Document, target, prediction and one probability column per label."""
    wide = scores.groupBy("doc_id").pivot("label", labels).agg(F.max("prob"))
    wide = wide.select("doc_id", *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(f"prob_{v}") for v in labels])
    pairs = best_label(scores).join(targets.select("doc_id", F.col("label").alias("target")), "doc_id", "left")
    return pairs.join(wide, "doc_id").select("doc_id", "target", "prediction", *[f"prob_{v}" for v in labels])


def ranked_outcomes(scores: DataFrame, targets: DataFrame, label=None, outcome: str | None = None) -> DataFrame:
    """Documents per label and outcome (tp, fp, fn, tn), most probable first."""
    pairs = outcomes(best_label(scores), targets)
    rows = scores.select("doc_id", "label", "prob")
    if label is not None:
        rows = rows.filter(F.col("label") == label)
    joined = rows.join(pairs, "doc_id")
    is_p, is_t = F.col("prediction") == F.col("label"), F.col("target") == F.col("label")
    kind = F.when(is_p & is_t, "tp").when(is_p, "fp").when(is_t, "fn").otherwise("tn")
    joined = joined.withColumn("outcome", kind)
    if outcome:
        joined = joined.filter(F.col("outcome") == outcome)
    ranked = rank_within(joined, ["label", "outcome"], [F.col("prob").desc(), F.col("doc_id").asc()])
    return ranked.select("label", "outcome", "rank", "doc_id", "target", "prediction", "prob")


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds; the counts are summed."""
    named = ["pr", "re", "f1", "tpr", "fpr", "auc"]
    means = [F.avg(c).alias(f"{c}_mean") for c in named]
    spread = [F.stddev_pop(c).alias(f"{c}_std") for c in named]
    sums = [F.sum(c).cast("long").alias(c) for c in ("tot", "clf", "cor")]
    return per_fold.groupBy("label").agg(*means, *spread, *sums)


def merge_fold_scores(parts: list[DataFrame], labels: list) -> DataFrame:
    """Scores of all folds together; a label that a fold lacks gets 0.0."""
    union = reduce(DataFrame.unionByName, [p.select("doc_id", "label", "prob") for p in parts])
    rows = union.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "prob"))).alias("_m"))
    names = F.array(*[F.lit(v) for v in labels])
    filled = F.transform(names, lambda v: F.struct(v.alias("label"), F.coalesce(F.element_at("_m", v), F.lit(0.0)).alias("prob")))
    return rows.select("doc_id", F.explode(filled).alias("_p")).select("doc_id", "_p.label", "_p.prob")

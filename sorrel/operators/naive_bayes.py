"""Multinomial naive Bayes as relational queries."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sorrel.operators.instances import in_order
from sorrel.operators.ngrams import KEY
from sorrel.plans.staging import rank_within, skew_join, stage

# Up to this many labels, all scores of a document are one aggregate row.
WIDE_LABELS = 64


@dataclass
class NaiveBayes:
    """``table`` has one row per feature: its df and its counts by label code."""

    labels: list
    label_docs: list[int]
    label_tokens: list[float]
    table: DataFrame  # ftype, feature, df, total, counts array<double>
    vocab_size: int
    alpha: float = 1.0
    fit_prior: bool = False

    def log_prior(self) -> list[float]:
        if not self.fit_prior:
            return [-math.log(len(self.labels))] * len(self.labels)
        n = sum(self.label_docs)
        return [math.log(c / n) for c in self.label_docs]

    def denominators(self) -> list[float]:
        return [math.log(t + self.alpha * self.vocab_size) for t in self.label_tokens]

    def log_probs(self) -> DataFrame:
        """One row per feature with its log probability by label code."""
        return self.table.select(*KEY, "df", log_weights(F.col("counts"), self.alpha, self.denominators()).alias("w"))

    def scores(self, features: DataFrame, docs: DataFrame) -> DataFrame:
        joined = skew_join(features.select("doc_id", *KEY, "value"), stage(self.log_probs(), "nb"), KEY)
        return label_scores(joined, docs.select("doc_id"), self.labels, _array(self.log_prior()), ["doc_id"])


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def log_weights(counts: Column, alpha: float, denominators: list[float]) -> Column:
    return F.zip_with(counts, _array(denominators), lambda c, d: F.log(c + F.lit(alpha)) - d)


def label_counts(rows: DataFrame, labels: list, key: list[str]) -> DataFrame:
    """``rows(key, label, value)`` to one row per key: df, total, counts by label code.

    With few labels one hash aggregate does it; with many, a key first gets at
    most one entry per label and these are then gathered.
    """
    if len(labels) <= WIDE_LABELS:
        cells = [F.sum(F.when(F.col("label") == F.lit(v), F.col("value")).otherwise(F.lit(0.0))) for v in labels]
        return rows.groupBy(*key).agg(
            F.count("*").alias("df"), F.sum("value").alias("total"), F.array(*cells).alias("counts")
        )
    by_label = rows.groupBy("label", *key).agg(F.sum("value").alias("_n"), F.count("*").alias("_df"))
    entries = F.map_from_entries(F.collect_list(F.struct("label", "_n")))
    sums = by_label.groupBy(*key).agg(F.sum("_df").alias("df"), F.sum("_n").alias("total"), entries.alias("_m"))
    order = F.array(*[F.lit(v) for v in labels])
    counts = F.transform(order, lambda v: F.coalesce(F.element_at("_m", v), F.lit(0.0)))
    return sums.select(*key, "df", "total", counts.alias("counts"))


def fit_naive_bayes(
    features: DataFrame,
    labels: DataFrame,
    alpha: float = 1.0,
    fit_prior: bool = False,
    vocab_size: int | None = None,
) -> NaiveBayes:
    """Counts per (label, feature); zero cells are implied."""
    key = ["doc_id", "copy"] if "copy" in labels.columns else ["doc_id"]
    docs = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = in_order(docs)
    joined = features.join(labels.select(*key, "label"), key)
    table = stage(label_counts(joined, order, KEY), "nb_counts")
    sums = table.agg(F.count("*").alias("v"), *[F.sum(F.col("counts")[i]).alias(f"t{i}") for i in range(len(order))]).first()
    tokens = [float(sums[f"t{i}"] or 0.0) for i in range(len(order))]
    size = sums["v"] if vocab_size is None else vocab_size
    return NaiveBayes(order, [docs[v] for v in order], tokens, table, size, alpha, fit_prior)


def label_scores(joined: DataFrame, docs: DataFrame, labels: list, prior: Column, key: list[str]) -> DataFrame:
    """Sum ``value * w`` per document and label, add the prior, apply softmax.

    ``prior`` is an array by label code over the columns of ``docs``.  Documents
    without known features get the prior.
    """
    k = len(labels)
    if k <= WIDE_LABELS:
        sums = joined.groupBy(*key).agg(
            F.array(*[F.sum(F.col("value") * F.col("w")[i]) for i in range(k)]).alias("_s")
        )
    else:
        cells = joined.select(*key, "value", F.posexplode("w").alias("code", "_w"))
        cells = cells.groupBy(*key, "code").agg(F.sum(F.col("value") * F.col("_w")).alias("s"))
        entry = F.array_sort(F.collect_list(F.struct("code", "s")))
        sums = cells.groupBy(*key).agg(F.transform(entry, lambda x: x["s"]).alias("_s"))
    every = docs.join(sums, key, "left")
    total = F.zip_with(F.coalesce("_s", _array([0.0] * k)), prior, lambda s, p: s + p)
    rows = every.select(*key, total.alias("_t"))
    raised = F.transform("_t", lambda t: F.exp(t - F.array_max("_t")))
    rows = rows.select(*key, raised.alias("_e"))
    rows = rows.withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    names = F.array(*[F.lit(v) for v in labels])
    pairs = F.arrays_zip(names.alias("label"), F.col("_e").alias("e"))
    out = rows.select(*key, "_z", F.explode(pairs).alias("_p"))
    return out.select(*key, F.col("_p.label").alias("label"), (F.col("_p.e") / F.col("_z")).alias("prob"))


# -------------------------------------------------------------------- insights


def _long(model: NaiveBayes, column: Column, name: str) -> DataFrame:
    names = F.array(*[F.lit(v) for v in model.labels])
    pairs = F.arrays_zip(names.alias("label"), column.alias("x"))
    rows = model.table.select(*KEY, F.explode(pairs).alias("_p"))
    return rows.select(*KEY, "_p.label", F.col("_p.x").alias(name))


def feature_count(model: NaiveBayes) -> DataFrame:
    """Count per (feature, label), zeros included."""
    return _long(model, F.col("counts"), "n")


def feature_log_prob(model: NaiveBayes) -> DataFrame:
    """Log probability per (feature, label)."""
    return _long(model, log_weights(F.col("counts"), model.alpha, model.denominators()), "log_prob")


def pivot_labels(long: DataFrame, value: str, labels: list) -> DataFrame:
    """One column per label."""
    return long.groupBy(*KEY).pivot("label", labels).agg(F.first(value))


def ranked_features(model: NaiveBayes, top: int | None = None) -> DataFrame:
    """Features of every label by descending log probability.

    The rank is taken from the counts, which order features alike and tie
    exactly.
    """
    weights = log_weights(F.col("counts"), model.alpha, model.denominators())
    names = F.array(*[F.lit(v) for v in model.labels])
    cells = F.arrays_zip(names.alias("label"), F.col("counts").alias("n"), weights.alias("w"))
    rows = model.table.select(*KEY, F.explode(cells).alias("_p"))
    rows = rows.select("_p.label", *KEY, "_p.n", F.col("_p.w").alias("log_prob"))
    order = [F.col("n").desc(), F.col("ftype").asc(), F.col("feature").asc()]
    if top is not None:
        rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("label", *KEY, "log_prob", "rank")
    return rank_within(rows, ["label"], order).select("label", *KEY, "log_prob", "rank")


def class_table(model: NaiveBayes, spark) -> DataFrame:
    """``(label, n, log_prior)`` per class."""
    rows = list(zip(model.labels, model.label_docs, model.log_prior()))
    return spark.createDataFrame(rows, "label string, n long, log_prior double")


# ----------------------------------------------------------------- alpha search

# The smoothing settings tried by the search.
ALPHAS = [2.0 * i / 19 for i in range(1, 20)]

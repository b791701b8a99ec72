"""Frequencies, feature weights, pruning, alignment and the fitted vectoriser.

All statistics read only the rows that exist; the zeros of a sparse table enter
by subtraction from document and label totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from sorrel.functions import stats
from sorrel.operators.balance import balance, balance_features
from sorrel.operators.ngrams import KEY, feature_totals
from sorrel.plans.staging import BROADCAST_ROWS, assign_position, join_documents, skew_join, small_side, stage


# ---------------------------------------------------------------- frequencies


def feature_frequency(features: DataFrame, labels: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """Summed count per feature, optionally inside one label."""
    if label is not None:
        ids = labels.filter(F.col("label") == label).select("doc_id")
        features = features.join(ids, "doc_id", "left_semi")
    return features.groupBy(*KEY).agg(F.sum("value").alias("frequency"))


def label_frequency(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def label_feature_frequency(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, ftype, feature, frequency, df)``; absent rows are zero."""
    joined = join_documents(features, labels.select("doc_id", "label"))
    return joined.groupBy("label", *KEY).agg(F.sum("value").alias("frequency"), F.count("*").alias("df"))


def idf_log10(features: DataFrame, n_docs: int) -> DataFrame:
    """``log10(N / frequency)``, 0.0 for a feature without occurrences."""
    freq = feature_frequency(features)
    idf = F.when(F.col("frequency") > 0, F.log10(F.lit(float(n_docs)) / F.col("frequency"))).otherwise(F.lit(0.0))
    return freq.select(*KEY, "frequency", idf.alias("idf"))


def idf_smooth(features: DataFrame, n_docs: int) -> DataFrame:
    """``ln((1 + N) / (1 + df)) + 1``."""
    return feature_totals(features).select(*KEY, "df", _smooth(n_docs).alias("idf"))


def _smooth(n_docs: int):
    return F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)


def information_gain(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``H(label) - H(label | presence of the feature)`` in bits."""
    present = label_feature_frequency(features, labels)
    n_docs = labels.count()
    sizes = small_side(stage(label_frequency(labels), "labels"))
    cell = present.join(sizes, "label")
    gained = stats.clog(F.col("df")) + stats.clog(F.col("n") - F.col("df")) - stats.clog(F.col("n"))
    per = cell.groupBy(*KEY).agg(F.sum(gained).alias("_g"), F.sum("df").alias("df"))
    n = F.lit(float(n_docs))
    gain = (stats.clog(n) - stats.clog(F.col("df")) - stats.clog(n - F.col("df")) + F.col("_g")) / n
    return per.select(*KEY, "df", gain.alias("gain"))


def label_correlation(features: DataFrame, numeric: DataFrame, with_p: bool = True) -> DataFrame:
    """Pearson r, and p, of every feature with ``numeric(doc_id, label_num)``."""
    y = F.col("label_num").cast("double")
    top = numeric.agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")).first()
    x = F.col("value")
    sums = (
        join_documents(features, numeric.select("doc_id", y.alias("label_num")))
        .groupBy(*KEY)
        .agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    )
    n = F.lit(float(top["n"]))
    r = stats.pearson(n, F.col("sx"), F.lit(top["sy"]), F.col("sxx"), F.lit(top["syy"]), F.col("sxy"))
    out = sums.select(*KEY, r.alias("r"))
    return out.withColumn("p", stats.pearson_p("r", n)) if with_p else out


# -------------------------------------------------------------------- weights


def weight_frequency(features: DataFrame) -> DataFrame:
    return features


def weight_binary(features: DataFrame) -> DataFrame:
    return features.withColumn("value", F.lit(1.0))


def normalize_l1(features: DataFrame) -> DataFrame:
    return _by_row_norm(features, F.sum(F.abs("value")))


def normalize_l2(features: DataFrame) -> DataFrame:
    return _by_row_norm(features, F.sqrt(F.sum(F.col("value") * F.col("value"))))


def _by_row_norm(features: DataFrame, norm) -> DataFrame:
    """Divide by the document's norm.

    A document's rows are brought together once, with their norm; the input is
    evaluated once and a row of the shuffle is never joined back.
    """
    rest = [c for c in features.columns if c != "doc_id"]
    rows = features.groupBy("doc_id").agg(norm.alias("_norm"), F.collect_list(F.struct(*rest)).alias("_rows"))
    each = rows.select("doc_id", "_norm", F.explode("_rows").alias("_r"))
    value = (F.col("_r.value") / F.col("_norm")).alias("value")
    return each.select("doc_id", *(value if c == "value" else F.col(f"_r.{c}") for c in rest)).select(*features.columns)


def weight_tfidf(features: DataFrame, idf: DataFrame) -> DataFrame:
    """Count times ``idf(ftype, feature, df, idf)``, rows scaled to L2 norm 1."""
    joined = skew_join(features, idf.select(*KEY, "df", "idf"), KEY)
    weighted = joined.withColumn("value", F.col("value") * F.col("idf")).select(*features.columns)
    return normalize_l2(weighted)


# ------------------------------------------------------- pruning and alignment


def prune_top_k(features_or_totals: DataFrame, k: int = 5000) -> DataFrame:
    """The ``k`` most frequent features, numbered in rank order.

    Spark keeps a top-k heap per partition, so no full sort takes place.
    """
    totals = features_or_totals
    if "total" not in totals.columns:
        totals = feature_totals(totals)
    order = [F.col("total").desc(), F.col("ftype").asc(), F.col("feature").asc()]
    counts = [c for c in ("total", "df") if c in totals.columns]
    top = totals.select(*KEY, *counts).orderBy(*order).limit(k)
    if k > BROADCAST_ROWS:
        return assign_position(top, order, "feature_id")
    # The k rows are in one partition already, so numbering them there is free.
    number = F.row_number().over(Window.orderBy(*order)) - 1
    return top.select(*KEY, number.alias("feature_id"), *counts)


def select_features(features: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of the selected features with their column number.

    Serves for train and test alike: a feature outside the selection is
    dropped and a selected feature that a document lacks stays an implied zero.
    """
    kept = selection.select(*KEY, "feature_id", "df")
    return skew_join(features, kept, KEY).select("doc_id", *KEY, "feature_id", "value")


align = select_features


def hstack(*tables: DataFrame) -> DataFrame:
    """Append feature sets of other types to the same documents."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


# ------------------------------------------------------------ fitted vectoriser


@dataclass
class Vectorizer:
    """What the train set fixed: selected columns, their weights, the mode."""

    weight: str
    n_docs: int
    selection: DataFrame  # ftype, feature, feature_id, df, idf, weight, rank
    train: DataFrame | None = None
    train_labels: DataFrame | None = None

    @property
    def size(self) -> int:
        return self.selection.count()


def fit_vectorizer(
    features: DataFrame,
    labels: DataFrame,
    weight: str = "frequency",
    prune: int | None = 5000,
    select: str | None = None,
    select_threshold=None,
    balanced: bool | str = False,
    seed: int = 42,
) -> Vectorizer:
    """Weight, prune, select and balance the train documents, in that order.

    ``fcbf`` takes values for categories; tf-idf gives nearly every cell a value of
    its own, so there the counts are the categories.
    """
    from sorrel.operators import selection as fs

    features = stage(features.join(labels.select("doc_id"), "doc_id", "left_semi"), "train")
    n_docs = labels.count()
    totals = feature_totals(features)
    pruned = prune_top_k(totals, prune) if prune else _all_ranked(totals)
    pruned = pruned.withColumn("idf", _smooth(n_docs))
    if weight == "tfidf":
        pruned = pruned.withColumn("weight", F.col("idf"))
    elif weight == "infogain":
        pruned = stage(pruned, "pruned")
        gains = information_gain(select_features(features, pruned).drop("feature_id"), labels)
        pruned = pruned.join(gains.select(*KEY, F.col("gain").alias("weight")), KEY, "left").fillna(0.0, ["weight"])
    elif weight in ("frequency", "binary"):
        pruned = pruned.withColumn("weight", F.col("total"))
    else:
        raise ValueError(f"unknown weight: {weight}")
    pruned = stage(pruned.withColumn("rank", F.col("feature_id")), "selection")
    model = Vectorizer(weight, n_docs, pruned)
    vectors = stage(apply_vectorizer(model, features), "vectors")

    if select:
        if select == "fcbf":
            categories = select_features(features, pruned) if weight == "tfidf" else vectors
            chosen = fs.fcbf(categories, labels, float(select_threshold or 0.0))
        elif select == "mrmr_linear":
            chosen = fs.mrmr_linear(vectors, labels, str(select_threshold))
        else:
            raise ValueError(f"unknown selector: {select}")
        kept = pruned.drop("feature_id", "rank", "weight").join(F.broadcast(chosen), KEY)
        model.selection = stage(kept.withColumn("feature_id", F.col("rank")), "selection")
        vectors = select_features(vectors.drop("feature_id"), model.selection)

    model.train, model.train_labels = vectors, labels
    if balanced:
        copies = stage(balance(labels, seed, "min" if balanced == "min" else "auto"), "balanced")
        model.train = balance_features(vectors, copies)
        model.train_labels = copies.select("doc_id", "copy", "label")
    return model


def _all_ranked(totals: DataFrame) -> DataFrame:
    order = [F.col("total").desc(), F.col("ftype").asc(), F.col("feature").asc()]
    return assign_position(totals, order, "feature_id")


def apply_vectorizer(model: Vectorizer, features: DataFrame) -> DataFrame:
    """Train-fitted columns and weights for any documents."""
    cols = model.selection.select(*KEY, "feature_id", "df", "idf", "weight")
    joined = skew_join(features.select("doc_id", *KEY, "value"), cols, KEY)
    value = {
        "frequency": F.col("value"),
        "binary": F.lit(1.0),
        "tfidf": F.col("value") * F.col("idf"),
        "infogain": F.col("weight"),
    }[model.weight]
    out = joined.select("doc_id", *KEY, "feature_id", value.alias("value"))
    return normalize_l2(out) if model.weight == "tfidf" else out

"""Writers and readers of results: features, selections, reports, models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import classification as mlc, regression as mlr
from pyspark.sql import DataFrame, SparkSession, functions as F

from sorrel.operators.boosting import BoostedTrees, Tree
from sorrel.operators.learners import Learner, OneVsRestLearner, PlattLearner, RegressionLearner
from sorrel.operators.naive_bayes import NaiveBayes
from sorrel.operators.perceptron import Perceptron


def write_features(features: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """Feature rows and vocabulary, both split by feature type."""
    features.write.mode("overwrite").partitionBy("ftype").parquet(f"{path}/features")
    vocabulary.write.mode("overwrite").partitionBy("ftype").parquet(f"{path}/vocabulary")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    features = spark.read.parquet(f"{path}/features").withColumn("ftype", F.col("ftype").cast("string"))
    vocabulary = spark.read.parquet(f"{path}/vocabulary").withColumn("ftype", F.col("ftype").cast("string"))
    return features.select("doc_id", "ftype", "feature", "value"), vocabulary


def write_selection(selection: DataFrame, path: str) -> None:
    """``feature <tab> weight`` in rank order."""
    selection.orderBy("rank").select("feature", "weight").write.mode("overwrite").csv(path, sep="\t")


def write_report_csv(table: DataFrame, path: str, digits: int = 2) -> None:
    """A report table with its header; rates are rounded for reading."""
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes]
    table.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_report_txt(table: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited text lines."""
    line = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in table.columns])
    table.select(line.alias("value")).write.mode("overwrite").text(path)


def _put(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def _facts(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/facts").first()["value"])


def save_model(model, path: str, spark: SparkSession) -> None:
    """Count models as a Parquet table, Spark ML models in their own form."""
    if isinstance(model, NaiveBayes):
        names = ("labels", "label_docs", "label_tokens", "vocab_size", "alpha", "fit_prior")
        _put(spark, path, {"kind": "naive_bayes", **{n: getattr(model, n) for n in names}})
        model.table.write.mode("overwrite").parquet(f"{path}/counts")
        return
    if isinstance(model, Perceptron):
        _put(spark, path, {"kind": "perceptron", "labels": model.labels, "size": model.weights.shape[1]})
        code, column = model.weights.nonzero()
        cells = [(int(c), int(i), float(model.weights[c, i])) for c, i in zip(code, column, strict=True)]
        spark.createDataFrame(cells, "code int, feature_id int, w double").write.mode("overwrite").parquet(f"{path}/weights")
        return
    if isinstance(model, RegressionLearner):
        _put(spark, path, {"kind": "regression", "size": model.size, "part": type(model.model).__name__})
        model.model.write().overwrite().save(f"{path}/part0")
        return
    if isinstance(model, BoostedTrees):
        rounds = [[vars(tree) for tree in trees] for trees in model.rounds]
        gains = [[f, *g] for f, g in model.gains.items()]
        _put(spark, path, {"kind": "boosted", "labels": model.labels, "size": model.size, "settings": model.settings, "rounds": rounds, "gains": gains})
        return
    if model.transform_vectors is not None:
        raise ValueError("a learner with a feature map is refitted, not saved")
    parts = model.models if isinstance(model, OneVsRestLearner) else [model.model]
    _put(spark, path, {
        "kind": type(model).__name__, "labels": model.labels, "size": model.size, "settings": model.settings,
        "parts": [type(p).__name__ for p in parts], "sigmoids": getattr(model, "sigmoids", None),
    })
    for i, part in enumerate(parts):
        part.write().overwrite().save(f"{path}/part{i}")


def load_model(path: str, spark: SparkSession):
    facts = _facts(spark, path)
    kind = facts.pop("kind")
    if kind == "naive_bayes":
        return NaiveBayes(table=spark.read.parquet(f"{path}/counts"), **facts)
    if kind == "perceptron":
        weights = np.zeros((len(facts["labels"]), facts["size"]))
        for r in spark.read.parquet(f"{path}/weights").collect():  # as many as the model in the driver holds
            weights[r["code"], r["feature_id"]] = r["w"]
        return Perceptron(facts["labels"], weights)
    if kind == "boosted":
        rounds = [[Tree(**tree) for tree in trees] for trees in facts["rounds"]]
        return BoostedTrees(facts["labels"], facts["size"], rounds, {f: (g, n) for f, g, n in facts["gains"]}, facts["settings"])
    if kind == "regression":
        return RegressionLearner(getattr(mlr, facts["part"]).load(f"{path}/part0"), facts["size"])
    parts = [getattr(mlc, name).load(f"{path}/part{i}") for i, name in enumerate(facts["parts"])]
    common = (facts["labels"], facts["size"], facts["settings"])
    if kind == "PlattLearner":
        return PlattLearner(None, *common, models=parts, sigmoids=[tuple(s) for s in facts["sigmoids"]])
    if kind == "OneVsRestLearner":
        return OneVsRestLearner(None, *common, models=parts)
    return Learner(parts[0], *common)

"""Spark ML learners behind one form: fit on vectors, score per label.

``Instances`` pairs a label order with a table ``(doc_id[, copy], label, code,
features)``; every fitted learner gives ``(doc_id, label, prob)``.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import classification as mlc, regression as mlr
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

import numpy as np
import pandas as pd

from sorrel.functions.hashing import hash_key
from sorrel.operators.boosting import BoostedTrees, fit_boosted
from sorrel.operators.instances import in_order, sparse_instances
from sorrel.plans.staging import stage

# The settings that a search tries.
SEARCH = {"logistic_regression": {"c": [0.001, 0.005, 0.01, 0.5, 1, 5, 10, 50, 100, 500, 1000], "penalty": ["l1", "l2"]}}

# Fits that run side by side, each with a cached copy of the train rows.
PARALLELISM = 4


def training_table(vectors: DataFrame, labels: DataFrame, size: int) -> tuple[list, DataFrame]:
    """Label order and the table of labelled vectors with numeric codes."""
    order = in_order(r["label"] for r in labels.select("label").distinct().collect())
    code = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("label")) - 1
    docs = labels.withColumn("code", code.cast("double"))
    return order, sparse_instances(vectors, docs, size)


def class_weights(labels: DataFrame, weights="balanced") -> dict:
    """``label -> weight``: N / (k * n) or an explicit mapping; the rest weigh 1."""
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if weights == "balanced":
        n = sum(counts.values())
        return {v: n / (len(counts) * c) for v, c in counts.items()}
    return {v: float((weights or {}).get(v, 1.0)) for v in counts}


def with_weights(table: DataFrame, labels: DataFrame, weights) -> DataFrame:
    if not weights:
        return table.withColumn("weight", F.lit(1.0))
    chosen = class_weights(labels, weights)
    col = F.lit(1.0)
    for label, w in chosen.items():
        col = F.when(F.col("label") == F.lit(label), F.lit(w)).otherwise(col)
    return table.withColumn("weight", col)


@dataclass
class Learner:
    """A fitted model with the label order of its training set."""

    model: object
    labels: list
    size: int
    settings: dict = field(default_factory=dict)
    features: DataFrame | None = None
    transform_vectors: object = None

    def _probabilities(self, table: DataFrame) -> DataFrame:
        return self.model.transform(table).select("doc_id", vector_to_array("probability").alias("_p"))

    def scores(self, vectors: DataFrame, docs: DataFrame) -> DataFrame:
        table = sparse_instances(vectors, docs.select("doc_id"), self.size)
        if self.transform_vectors is not None:
            table = self.transform_vectors(table)
        return self.score_table(table)

    def score_table(self, table: DataFrame) -> DataFrame:
        rows = self._probabilities(table)
        names = F.array(*[F.lit(v) for v in self.labels])
        pairs = F.arrays_zip(names.alias("label"), F.col("_p").alias("prob"))
        return rows.select("doc_id", F.explode(pairs).alias("_z")).select("doc_id", "_z.label", "_z.prob")


@dataclass
class OneVsRestLearner(Learner):
    """One binary model per label; shares are the normalised positive scores."""

    models: list = field(default_factory=list)

    def _probabilities(self, table: DataFrame) -> DataFrame:
        cols = ["doc_id", "features"]
        out = table.select(*cols)
        for i, model in enumerate(self.models):
            one = model.transform(out)
            out = one.select(*cols, vector_to_array("probability")[1].alias(f"_{i}"))
            cols.append(f"_{i}")
        k = len(self.models)
        if len(self.labels) == 2:
            return out.select("doc_id", F.array(1 - F.col("_0"), F.col("_0")).alias("_p"))
        total = sum((F.col(f"_{i}") for i in range(1, k)), F.col("_0"))
        share = [F.when(total > 0, F.col(f"_{i}") / total).otherwise(F.lit(1.0 / k)) for i in range(k)]
        return out.select("doc_id", F.array(*share).alias("_p"))


def one_vs_rest(table: DataFrame, labels: list, size: int, fit, **extra) -> OneVsRestLearner:
    """Fit ``fit(table with a 0/1 code)`` per label, once for two labels; some labels are fitted side by side, like searched settings."""
    targets = [1] if len(labels) == 2 else range(len(labels))
    table = stage(table, "train")
    coded = [table.withColumn("code", (F.col("code") == float(t)).cast("double")) for t in targets]
    with ThreadPool(max(1, min(PARALLELISM, len(coded)))) as pool:
        models = pool.map(inheritable_thread_target(table.sparkSession)(fit), coded, 1)
    return OneVsRestLearner(None, labels, size, models=models, **extra)


# ----------------------------------------------------------------- linear models


def logistic_regression(vectors, labels, size, c=1.0, penalty="l2", multiclass="ovr", max_iter=1000) -> Learner:
    """L1 / L2 logistic regression, one against the rest or multinomial."""
    order, table = training_table(vectors, labels, size)
    n = table.count()
    estimator = mlc.LogisticRegression(
        labelCol="code", regParam=1.0 / (c * n), elasticNetParam=1.0 if penalty == "l1" else 0.0, maxIter=max_iter,
        standardization=False, family="multinomial" if multiclass == "multinomial" else "binomial",
    )
    settings = {"c": c, "penalty": penalty, "multiclass": multiclass, "max_iter": max_iter}
    if multiclass == "multinomial":
        return Learner(estimator.fit(table), order, size, settings)
    return one_vs_rest(table, order, size, estimator.fit, settings=settings)


def _margin(model, table: DataFrame, name: str, cols: list[str]) -> DataFrame:
    return model.transform(table).select(*cols, vector_to_array("rawPrediction")[1].alias(name))


@dataclass
class PlattLearner(OneVsRestLearner):
    """Margins of linear machines turned into probabilities by fitted sigmoids."""

    sigmoids: list = field(default_factory=list)

    def margins(self, table: DataFrame) -> DataFrame:
        cols, out = ["doc_id", "features"], table.select("doc_id", "features")
        for i, model in enumerate(self.models):
            out = _margin(model, out, f"_{i}", cols)
            cols.append(f"_{i}")
        return out.drop("features")

    def _probabilities(self, table: DataFrame) -> DataFrame:
        out = self.margins(table)
        prob = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col(f"_{i}") + F.lit(b)))) for i, (a, b) in enumerate(self.sigmoids)]
        if len(self.labels) == 2:
            return out.select("doc_id", F.array(1 - prob[0], prob[0]).alias("_p"))
        total = sum(prob[1:], prob[0])
        return out.select("doc_id", F.array(*[p / total for p in prob]).alias("_p"))


def linear_svm(vectors, labels, size, c=1.0, class_weight="balanced", max_iter=100, cv=3, seed=42, feature_map=None) -> PlattLearner:
    """Linear support vector machine with out-of-fold Platt probabilities."""
    order, table = training_table(vectors, labels, size)
    table = with_weights(table, labels, class_weight)
    if feature_map is not None:
        table = feature_map(table)
    part = F.conv(F.substring(hash_key(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long") % cv
    table = stage(table.withColumn("part", part), "train")
    # The loss is averaged over the weights, so a penalty of 1 / (C * their sum) gives C.
    heavy = {r["part"]: r["w"] for r in table.groupBy("part").agg(F.sum("weight").alias("w")).collect()}
    whole = sum(heavy.values())

    def svc(weight: float) -> mlc.LinearSVC:
        return mlc.LinearSVC(labelCol="code", weightCol="weight", regParam=1.0 / (c * weight), maxIter=max_iter, standardization=False)

    targets = [1] if len(order) == 2 else range(len(order))
    models, sigmoids = [], []
    for t in targets:
        binary = table.withColumn("code", (F.col("code") == float(t)).cast("double"))
        models.append(svc(whole).fit(binary))
        held = None
        for f in range(cv):
            fold = svc(whole - heavy.get(f, 0.0)).fit(binary.filter(F.col("part") != f))
            part_rows = _margin(fold, binary.filter(F.col("part") == f), "m", ["code"])
            held = part_rows if held is None else held.unionByName(part_rows)
        ready = held.select("code", array_to_vector(F.array("m")).alias("features"))
        curve = mlc.LogisticRegression(labelCol="code", maxIter=50).fit(ready)
        sigmoids.append((float(curve.coefficients[0]), float(curve.intercept)))
    settings = {"c": c, "class_weight": class_weight}
    return PlattLearner(None, order, size, settings, transform_vectors=feature_map, models=models, sigmoids=sigmoids)


def polynomial_map(degree: int):
    """Explicit polynomial features; for few, selected columns."""

    def apply(table: DataFrame) -> DataFrame:
        step = PolynomialExpansion(degree=degree, inputCol="features", outputCol="_x")
        return step.transform(table).drop("features").withColumnRenamed("_x", "features")

    return apply


def fourier_map(size: int, gamma: float = 0.1, components: int = 256, seed: int = 42):
    """Random Fourier features of the RBF kernel (Rahimi & Recht 2007)."""

    @F.pandas_udf("array<double>")
    def project(ids: pd.Series, vals: pd.Series) -> pd.Series:
        rng = np.random.default_rng(seed)
        w = rng.normal(scale=np.sqrt(2 * gamma), size=(size, components))
        b = rng.uniform(0, 2 * np.pi, components)
        out = [np.sqrt(2 / components) * np.cos(np.asarray(v, float) @ w[np.asarray(i, np.int64)] + b) for i, v in zip(ids, vals)]
        return pd.Series([list(x) for x in out])

    def apply(table: DataFrame) -> DataFrame:
        dense = vector_to_array("features")
        pairs = F.filter(F.transform(dense, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda q: q["x"] != 0)
        ids, vals = F.transform("_q", lambda q: q["i"]), F.transform("_q", lambda q: q["x"])
        rows = table.withColumn("_q", pairs).withColumn("features", array_to_vector(project(ids, vals)))
        return rows.drop("_q")

    return apply


def kernel_svm(vectors, labels, size, kernel="rbf", gamma=0.1, degree=2, c=1.0, class_weight="balanced", **extra):
    """Non-linear kernels as explicit feature maps before the linear machine."""
    if kernel == "linear":
        return linear_svm(vectors, labels, size, c, class_weight, **extra)
    feature_map = polynomial_map(degree) if kernel == "poly" else fourier_map(size, gamma)
    return linear_svm(vectors, labels, size, c, class_weight, feature_map=feature_map, **extra)


def linear_regression(vectors, numeric, size, fit_intercept=True, normalize=False):
    """Least squares on ``numeric(doc_id, label_num)``: ``predict(vectors, docs)``."""
    table = sparse_instances(vectors, numeric.withColumn("code", F.col("label_num").cast("double")), size)
    estimator = mlr.LinearRegression(labelCol="code", fitIntercept=fit_intercept, standardization=normalize)
    return RegressionLearner(estimator.fit(table), size)


@dataclass
class RegressionLearner:
    model: object
    size: int

    def predict(self, vectors: DataFrame, docs: DataFrame) -> DataFrame:
        table = sparse_instances(vectors, docs.select("doc_id"), self.size)
        return self.model.transform(table).select("doc_id", "prediction")


# -------------------------------------------------------------------------- trees


def decision_tree(vectors, labels, size, class_weight=None, max_depth=10) -> Learner:
    order, table = training_table(vectors, labels, size)
    table = with_weights(table, labels, class_weight)
    tree = mlc.DecisionTreeClassifier(labelCol="code", weightCol="weight", maxDepth=max_depth)
    return Learner(tree.fit(table), order, size, {"class_weight": class_weight, "max_depth": max_depth})


def random_forest(vectors, labels, size, n_estimators=100, max_depth=10, seed=7) -> Learner:
    order, table = training_table(vectors, labels, size)
    forest = mlc.RandomForestClassifier(labelCol="code", numTrees=n_estimators, maxDepth=max_depth, seed=seed)
    return Learner(forest.fit(table), order, size, {"n_estimators": n_estimators, "max_depth": max_depth})


boosted_trees = fit_boosted


# ------------------------------------------------------------------------- search


def _logistic(params: dict, n: int):
    return {"regParam": 1.0 / (params["c"] * n), "elasticNetParam": 1.0 if params.get("penalty") == "l1" else 0.0}


def search(vectors, labels, size, grid: dict, n_iter=None, folds=5, scoring="f1_micro", seed=42, parallelism=4):
    """Best logistic-regression settings by validation over hashed folds, fitted side by side.

    Runs search any classifier's parameters through ``plans.search``.

    Without ``n_iter`` all settings are tried, else a seeded sample of them.
    Gives the settings and a list of ``(settings, score)``.
    """
    order, table = training_table(vectors, labels, size)
    part = F.conv(F.substring(hash_key(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long") % folds
    table = stage(table.withColumn("part", part.cast("int")), "train")
    n = table.count()
    family = "binomial" if len(order) == 2 else "multinomial"
    lr = mlc.LogisticRegression(labelCol="code", standardization=False, family=family, maxIter=50)
    tried = [dict(zip(grid, values)) for values in _product(list(grid.values()))]
    if n_iter is not None and n_iter < len(tried):
        tried = random.Random(seed).sample(tried, n_iter)
    maps = []
    for params in tried:
        builder = ParamGridBuilder()
        for name, value in _logistic(params, n).items():
            builder.addGrid(lr.getParam(name), [value])
        maps.extend(builder.build())
    cv = CrossValidator(
        estimator=lr, estimatorParamMaps=maps, evaluator=scorer(scoring, len(order)), numFolds=folds, foldCol="part", parallelism=parallelism
    )
    fitted = cv.fit(table)
    scored = list(zip(tried, fitted.avgMetrics))
    best = max(scored, key=lambda s: s[1])[0]
    return best, scored, Learner(fitted.bestModel, order, size, best)


def _product(lists: list) -> list[list]:
    out = [[]]
    for values in lists:
        out = [row + [v] for row in out for v in values]
    return out


def scorer(scoring: str, n_labels: int = 2):
    """Evaluator for ``f1_micro`` (accuracy for single labels) or ``roc_auc`` of two labels."""
    if scoring == "roc_auc":
        if n_labels > 2:
            raise ValueError("roc_auc of more than two labels: see plans.search")
        return BinaryClassificationEvaluator(labelCol="code", metricName="areaUnderROC")
    return MulticlassClassificationEvaluator(labelCol="code", metricName="accuracy")


# ----------------------------------------------------------------------- insights


def _names(selection: DataFrame) -> DataFrame:
    return selection.select(F.col("feature_id").cast("int").alias("feature_id"), "ftype", "feature")


def linear_weights(learner, selection: DataFrame) -> DataFrame:
    """``(ftype, feature, label, weight)`` of a linear model."""
    rows = []
    if isinstance(learner, OneVsRestLearner):
        targets = learner.labels[1:] if len(learner.labels) == 2 else learner.labels
        for label, model in zip(targets, learner.models):
            rows.extend((j, label, float(w)) for j, w in enumerate(model.coefficients.toArray()))
    else:
        matrix = learner.model.coefficientMatrix.toArray()
        rows.extend((j, learner.labels[i], float(w)) for i in range(matrix.shape[0]) for j, w in enumerate(matrix[i]))
    spark = selection.sparkSession
    table = spark.createDataFrame(rows, "feature_id int, label string, weight double")
    return _names(selection).join(table, "feature_id").select("ftype", "feature", "label", "weight")


def feature_importance(learner, selection: DataFrame) -> DataFrame:
    """``(ftype, feature, importance)``, the mean over the binary models."""
    if isinstance(learner, BoostedTrees):
        rows = [(int(j), float(v)) for j, v in learner.importance().items()]
        return _named_importance(rows, selection)
    models = learner.models if isinstance(learner, OneVsRestLearner) else [learner.model]
    total = sum(m.featureImportances.toArray() for m in models) / len(models)
    return _named_importance([(j, float(v)) for j, v in enumerate(total) if v > 0], selection)


def _named_importance(rows: list, selection: DataFrame) -> DataFrame:
    table = selection.sparkSession.createDataFrame(rows, "feature_id int, importance double")
    named = _names(selection).join(table, "feature_id").select("ftype", "feature", "importance")
    return named.orderBy(F.col("importance").desc(), "ftype", "feature")


def parameter_settings(learner, spark) -> DataFrame:
    rows = [(k, str(v)) for k, v in sorted(learner.settings.items())]
    return spark.createDataFrame(rows, "parameter string, value string")

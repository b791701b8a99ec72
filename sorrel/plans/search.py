"""Search for a classifier's parameters by validation on the train documents.

An option of a run may be a list of values or the word ``search``, which stands
for the values below.  All settings, or as many seeded draws as
``Settings.iterations`` says, are fitted on hashed folds; the scores of all held-out
documents and settings are judged by one job.  Logistic settings are fitted side by side
in the same passes over the rows.
"""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sorrel.functions.hashing import hash_key
from sorrel.operators import many
from sorrel.plans.staging import Scratch, running_sum, stage

# What ``search`` tries for each parameter.
ALPHAS = [round(2 * i / 19, 10) for i in range(1, 20)]
VALUES = {
    "naive_bayes": {"alpha": ALPHAS},
    "svm": {
        "c": [0.001, 0.005, 0.01, 0.5, 1, 5, 10, 50, 100, 500, 1000],
        "kernel": ["linear", "rbf", "poly"],
        "gamma": [0.0005, 0.002, 0.008, 0.032, 0.128, 0.512, 1.024, 2.048],
        "degree": [1, 2, 3, 4],
    },
    "logistic_regression": {"c": [0.001, 0.005, 0.01, 0.5, 1, 5, 10, 50, 100, 500, 1000], "penalty": ["l1", "l2"]},
    "xgboost": {
        "n_estimators": [100, 200, 300, 400, 500, 600, 700, 800, 900],
        "min_child_weight": [1, 2, 3, 4, 5],
        "max_depth": [3, 4, 5, 6, 7, 8, 9],
        "gamma": [0.0, 0.1, 0.2, 0.3, 0.4],
        "subsample": [0.6, 0.7, 0.8, 0.9],
        "colsample_bytree": [0.6, 0.7, 0.8, 0.9],
        "scale_pos_weight": [1, 3, 5, 7, 9],
    },
    "knn": {"k": [3, 5, 7, 9], "weights": ["uniform", "distance"], "metric": ["minkowski", "euclidean", "manhattan", "hamming"]},
    "perceptron": {"alpha": ALPHAS},
}
# Classifiers whose settings are always drawn; others only beyond three varied parameters.
DRAWN = ("svm", "knn")


def grid_of(name: str, options: dict) -> dict:
    """The values of every parameter that is to be searched."""
    out = {}
    for parameter, value in options.items():
        if isinstance(value, str) and value == "search":
            if parameter not in VALUES.get(name, {}):
                raise ValueError(f"no values to search for {name} {parameter}")
            out[parameter] = VALUES[name][parameter]
        elif isinstance(value, (list, tuple)):
            out[parameter] = list(value)
    return out


def settings_to_try(name: str, grid: dict, iterations: int, seed: int) -> list[dict]:
    """All settings, or ``iterations`` different draws."""
    total = math.prod(len(v) for v in grid.values())
    drawn = name in DRAWN or sum(len(v) > 1 for v in grid.values()) > 3
    numbers = random.Random(seed).sample(range(total), min(iterations, total)) if drawn else range(total)
    out = []
    for number in numbers:
        setting = {}
        for parameter, values in grid.items():
            number, at = divmod(number, len(values))
            setting[parameter] = values[at]
        out.append(setting)
    return out


def accuracy(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """``(setting, score)``: share of right documents, the pooled F1 of single labels."""
    best = F.min(F.struct((-F.col("prob")).alias("p"), "label"))
    guess = scores.groupBy("setting", "doc_id").agg(best.alias("b")).select("setting", "doc_id", F.col("b.label").alias("prediction"))
    right = (F.col("prediction") == F.col("target")).cast("double")
    return guess.join(labels.select("doc_id", F.col("label").alias("target")), "doc_id").groupBy("setting").agg(F.avg(right).alias("score"))


def label_auc(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """``(setting, label, auc)``: area under the curve of each label against the rest.

    Documents are counted by their exact probability; the documents below each probability come from
    running sums over a range sort, so no label's documents meet in one task.  Equal probabilities
    count half.  Labels that hold all or no documents have no area.
    """
    told = scores.join(labels.select("doc_id", F.col("label").alias("target")), "doc_id")
    hit = (F.col("label") == F.col("target")).cast("long")
    cells = told.groupBy("setting", "label", "prob").agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("n"))
    ranked = running_sum(cells, ["setting", "label"], ["prob"], "n", "under")
    # Products of counts outgrow a long.
    pairs = F.sum(F.col("p").cast("double") * (F.col("under") + F.col("n") / 2))
    area = pairs / (F.sum("p").cast("double") * F.sum("n"))
    return ranked.groupBy("setting", "label").agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), area).alias("auc"))


def roc_auc(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """``(setting, score)``: mean of ``label_auc`` over the labels that have one."""
    return label_auc(scores, labels).groupBy("setting").agg(F.avg("auc").alias("score"))


SCORES = {"roc_auc": roc_auc, "f1_micro": accuracy, "accuracy": accuracy}


def _placed(labels: DataFrame, folds: int, seed) -> DataFrame:
    """Labels with the hashed fold ``_part`` of their document."""
    part = F.conv(F.substring(hash_key(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long") % folds
    return stage(labels.withColumn("_part", part), "search")


def _judged(held: DataFrame, placed: DataFrame, tried: list[dict], scoring: str) -> tuple[dict, list]:
    truth = placed.select("doc_id", "label").distinct()
    judged = {r["setting"]: r["score"] for r in SCORES[scoring](held, truth).collect()}
    scored = [(setting, judged.get(n)) for n, setting in enumerate(tried)]
    best = max(range(len(tried)), key=lambda n: (-math.inf if scored[n][1] is None else scored[n][1], -n))
    return tried[best], scored


def search(fit_score, train: DataFrame, labels: DataFrame, tried: list[dict], scoring: str, folds: int = 5, seed: int = 42) -> tuple[dict, list]:
    """The best of the settings and a list of ``(setting, score)``.

    ``fit_score(setting, train, train_labels, test, test_docs)`` gives scores.  Folds
    follow the document, so balanced copies of one share a fold.  Ties go to the setting tried first.
    Tables staged on the way are deleted.
    """
    if scoring not in SCORES:
        raise ValueError(f"unknown scoring: {scoring}")
    with Scratch():
        placed = _placed(labels, folds, seed)
        train = stage(train, "search_rows")
        parts = sorted(r["_part"] for r in placed.select("_part").distinct().collect())
        held = []
        for f in parts if len(parts) > 1 else []:
            own, rest = (placed.filter(c).drop("_part") for c in (F.col("_part") == f, F.col("_part") != f))
            rows = train.join(rest.select("doc_id").distinct(), "doc_id", "left_semi")
            docs = own.select("doc_id").distinct()
            test = train.join(docs, "doc_id", "left_semi").drop("copy").distinct()
            for n, setting in enumerate(tried):
                with Scratch() as made:
                    found = fit_score(setting, rows, rest, test, docs)
                    held.append(stage(found.select("doc_id", "label", "prob", F.lit(n).alias("setting")), "held"))
                    made.keep(held[-1])
        if not held:
            return tried[0], [(tried[0], None)]
        return _judged(reduce(DataFrame.unionByName, held), placed, tried, scoring)


def search_logistic(
    train: DataFrame, labels: DataFrame, size: int, tried: list[dict], scoring: str, max_iter: int = 1000, folds: int = 5, seed: int = 42
) -> tuple[dict, list]:
    """As :func:`search` for logistic regression, one label against the rest: all settings, folds and labels in one fit.

    ``tried`` holds ``c`` and ``penalty``.  A label that a fold's train documents lack is fitted on the others alone.
    """
    if scoring not in SCORES:
        raise ValueError(f"unknown scoring: {scoring}")
    with Scratch():
        placed = _placed(labels, folds, seed)
        order, rows = many.coded(placed.withColumn("fold", F.col("_part").cast("int")).drop("_part"))
        packed = many.packed_rows(train, rows)
        parts = sorted(r["fold"] for r in packed.select("fold").distinct().collect())
        if len(parts) < 2:
            return tried[0], [(tried[0], None)]
        specs, names = [], []
        for n, setting in enumerate(tried):
            for fold in parts:
                for target in many.targets(order):
                    specs.append(many.LinearSpec(target, setting.get("c", 1.0), setting.get("penalty", "l2"), fold=fold))
                    names.append(n)
        models = many.fit_many(packed, size, specs, max_iter)
        # Balanced copies of a document have the same features.
        once = packed.dropDuplicates(["doc_id"]) if "copy" in packed.columns else packed
        held = stage(many.held_out_scores(once, models, order, names), "held")
        return _judged(held, placed, tried, scoring)

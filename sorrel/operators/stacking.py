"""Predictions as features: appending, out-of-fold features and stacking.

A *trainer* is a function ``(train_features, train_labels, test_features,
test_docs) -> scores(doc_id, label, prob)`` that does everything fitted on the
train documents.  The functions here turn trainers into features and into
further trainers, so validation composes with all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sorrel.operators.folds import cross_validate, make_folds
from sorrel.operators.instances import label_list, predictions
from sorrel.plans.staging import stage

Trainer = Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]


def prediction_feature(predicted: DataFrame, order: list, name: str) -> DataFrame:
    """The predicted label's rank among the train labels as one feature."""
    code = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("prediction")) - 1
    return predicted.select("doc_id", F.lit("prediction").alias("ftype"), F.lit(name).alias("feature"), code.cast("double").alias("value"))


def probability_features(scores: DataFrame, labels: list | None = None) -> DataFrame:
    """Class probabilities as features, of all or of chosen labels."""
    rows = scores if labels is None else scores.filter(F.col("label").isin(labels))
    name = F.concat(F.col("label").cast("string"), F.lit("_prediction_prob"))
    return rows.select("doc_id", F.lit("probability").alias("ftype"), name.alias("feature"), F.col("prob").alias("value"))


def _as_features(scores, order, name, probs, include):
    return probability_features(scores, include) if probs else prediction_feature(predictions(scores), order, name)


def out_of_fold_features(
    trainer: Trainer, features, labels, test_features, test_docs, name="BOW", n: int = 5, probs: bool = False, include=None
) -> tuple[DataFrame, DataFrame]:
    """Train features from n-fold predictions, test features from a full fit."""
    order = label_list(labels)
    folds = stage(make_folds(labels, n), "oof")
    held = cross_validate(features, labels, folds, trainer).drop("fold")
    full = trainer(features, labels, test_features, test_docs)
    both = [stage(_as_features(s, order, name, probs, include), "oof_features") for s in (held, full)]
    return both[0], both[1]


def _present(*tables: DataFrame) -> DataFrame:
    """Feature tables together; a zero code is an absent row like any zero."""
    return reduce(DataFrame.unionByName, [t.select("doc_id", "ftype", "feature", "value") for t in tables]).filter("value <> 0")


def append_trainer(
    final: Trainer, external: DataFrame, text: Trainer | None = None, n: int = 5, probs: bool = False, include=None
) -> Trainer:
    """Text features, or the prediction that ``text`` makes of them, joined with
    ``external(doc_id, ftype, feature, value)``, then a final classifier."""

    def train(features, labels, test_features, test_docs):
        own = external.join(labels.select("doc_id"), "doc_id", "left_semi")
        far = external.join(test_docs.select("doc_id"), "doc_id", "left_semi")
        if text is not None:
            features, test_features = out_of_fold_features(text, features, labels, test_features, test_docs, "BOW", n, probs, include)
        return final(_present(features, own), labels, _present(test_features, far), test_docs)

    return train


def ensemble_trainer(base: dict[str, Trainer], final: Trainer, n: int = 5) -> Trainer:
    """Out-of-fold labels of each base learner become codes for the final one."""

    def train(features, labels, test_features, test_docs):
        parts = [
            out_of_fold_features(trainer, features, labels, test_features, test_docs, name, n) for name, trainer in base.items()
        ]
        return final(_present(*[p[0] for p in parts]), labels, _present(*[p[1] for p in parts]), test_docs)

    return train


def classify_append(final, features, labels, test_features, test_docs, external, **extra) -> DataFrame:
    return append_trainer(final, external, **extra)(features, labels, test_features, test_docs)


def stack_ensemble(base, final, features, labels, test_features, test_docs, n: int = 5) -> DataFrame:
    return ensemble_trainer(base, final, n)(features, labels, test_features, test_docs)


def validate_append(final, features, labels, folds, external, **extra) -> DataFrame:
    return cross_validate(features, labels, folds, append_trainer(final, external, **extra))


def validate_ensemble(base, final, features, labels, folds, n: int = 5) -> DataFrame:
    return cross_validate(features, labels, folds, ensemble_trainer(base, final, n))

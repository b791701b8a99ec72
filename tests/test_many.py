"""Many linear models in one fit, against separate fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel.operators import evolve, learners, many
from sorrel.plans import search
from sorrel.plans.staging import Scratch, stage


@pytest.fixture(scope="module")
def data(spark):
    """150 documents of three labels with twelve features, some of them empty."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(150):
        label = rng.randrange(3)
        labels.append((i, "abc"[label]))
        for j in range(12 if i % 10 else 0):
            value = rng.gauss(1.0 if j % 3 == label else 0.0, 1.0)
            if rng.random() < 0.6:
                rows.append((i, j, value))
    vectors = stage(spark.createDataFrame(rows, "doc_id long, feature_id int, value double"))
    return vectors, stage(spark.createDataFrame(labels, "doc_id long, label string"))


def _matrix(vectors, labels, size=12):
    x, y = np.zeros((150, size)), [None] * 150
    for r in vectors.collect():
        x[r["doc_id"], r["feature_id"]] = r["value"]
    for r in labels.collect():
        y[r["doc_id"]] = r["label"]
    return x, np.array(y)


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_models_equal_fits_of_their_own(spark, data, penalty):
    vectors, labels = data
    own = learners.logistic_regression(vectors, labels, 12, c=0.5, penalty=penalty, max_iter=500)
    order, rows = many.coded(labels)
    found = many.fit_many(many.packed_rows(vectors, rows), 12, [many.LinearSpec(t, 0.5, penalty) for t in many.targets(order)])
    for model, got in zip(own.models, found.weights):
        assert got[:-1] == pytest.approx(model.coefficients.toArray(), abs=2e-3)
        assert got[-1] == pytest.approx(model.intercept, abs=2e-3)
    if penalty == "l1":
        assert (found.weights[:, :-1] == 0).any()


def test_gradients_against_numeric_differences(spark, data):
    vectors, labels = data
    order, rows = many.coded(labels.withColumn("weight", F.col("doc_id") % 3 + 0.5).withColumn("fold", (F.col("doc_id") % 2).cast("int")))
    packed = many.packed_rows(vectors, rows)
    specs = [many.LinearSpec(1, loss="logistic", fold=0), many.LinearSpec(2, loss="squared_hinge")]
    rng = np.random.default_rng(1)
    w = rng.normal(size=(2, 13))
    sums = many.gradients(packed, specs, w)
    x, y = _matrix(vectors, labels)
    heavy = np.arange(150) % 3 + 0.5

    def loss(i, v):
        z = (x @ v[:-1] + v[-1]) * np.where(y == order[specs[i].target], 1, -1)
        each = np.log1p(np.exp(-z)) if i == 0 else np.maximum(0, 1 - z) ** 2
        return (each * heavy * ((np.arange(150) % 2 != 0) if i == 0 else 1)).sum()

    for i in range(2):
        assert sums[i, 0] == pytest.approx(loss(i, w[i]))
        for j in range(13):
            step = np.eye(13)[j] * 1e-5
            assert sums[i, 2 + j] == pytest.approx((loss(i, w[i] + step) - loss(i, w[i] - step)) / 2e-5, rel=1e-4, abs=1e-4)


def test_masked_models_use_their_columns_only(spark, data):
    vectors, labels = data
    order, rows = many.coded(labels)
    found = many.fit_many(many.packed_rows(vectors, rows), 12, [many.LinearSpec(0, columns=(2, 5)), many.LinearSpec(0, columns=())])
    alone = many.fit_many(
        many.packed_rows(vectors.filter("feature_id in (2, 5)"), rows), 12, [many.LinearSpec(0)]
    )
    assert set(np.flatnonzero(found.weights[0][:-1])) == {2, 5}
    assert found.weights[0] == pytest.approx(alone.weights[0], abs=1e-6)
    assert not found.weights[1][:-1].any() and found.weights[1][-1] < 0


def test_search_finds_the_winner_of_separate_fits(spark, data):
    vectors, labels = data
    labels = stage(labels.withColumn("label", F.when(F.col("label") == "a", "a").otherwise("b")))
    tried = [{"c": 0.02, "penalty": "l1"}, {"c": 0.3, "penalty": "l2"}, {"c": 10.0, "penalty": "l2"}]

    def fit_score(setting, rows, own, test, docs):
        return learners.logistic_regression(rows, own, 12, max_iter=300, **setting).scores(test, docs)

    apart = search.search(fit_score, vectors, labels, tried, "roc_auc", folds=2)
    found = search.search_logistic(vectors, labels, 12, tried, "roc_auc", folds=2)
    assert found[0] == apart[0]
    for (_, a), (_, b) in zip(found[1], apart[1]):
        assert a == pytest.approx(b, abs=5e-3)


def test_passes_do_not_grow_with_the_grid(spark, data):
    vectors, labels = data
    order, rows = many.coded(labels)
    packed = many.packed_rows(vectors, rows)
    cs = [0.01 * 2**i for i in range(6)]
    alone = [many.fit_many(packed, 12, [many.LinearSpec(0, c)]).passes for c in (cs[0], cs[-1])]
    assert many.fit_many(packed, 12, [many.LinearSpec(0, c) for c in cs]).passes <= max(alone) + 3


@pytest.mark.parametrize("kind", ["logistic_regression", "svm"])
def test_linear_candidates_against_brute_force(spark, data, kind):
    vectors, labels = data
    sample = stage(evolve.train_test_sample(labels, 0.7))
    population = stage(evolve.random_population(spark, 12, 4))
    params = spark.createDataFrame([(i, 0.5 + i) for i in range(4)], "cand_id long, alpha double")
    problem = evolve.prepare_linear(vectors, sample, 12)
    got = {r["cand_id"]: r for r in evolve.score_linear_candidates(problem, population, params, loss=evolve.LINEAR[kind]).collect()}
    x, y = _matrix(vectors, labels)
    train = np.zeros(150, dtype=bool)
    train[[r["doc_id"] for r in sample.filter("train").collect()]] = True
    masks = {}
    for r in population.collect():
        masks.setdefault(r["cand_id"], []).append(r["feature_id"])
    for cand, cols in masks.items():
        margins = []
        for label in "abc":
            a = np.hstack([x[train][:, sorted(cols)], np.ones((train.sum(), 1))])
            sign, w = np.where(y[train] == label, 1.0, -1.0), np.zeros(a.shape[1])
            ridge = np.append(np.ones(len(cols)), 0.0) / ((0.5 + cand) * train.sum())
            for _ in range(8_000):
                z = sign * (a @ w)
                slope = -1 / (1 + np.exp(z)) if kind == "logistic_regression" else -2 * np.maximum(0, 1 - z)
                w = w - 0.05 * (a.T @ (slope * sign) / len(a) + ridge * w)
            margins.append(x[~train][:, sorted(cols)] @ w[:-1] + w[-1])
        right = (np.array(list("abc"))[np.argmax(margins, axis=0)] == y[~train]).mean()
        # Rows at a border may go either way.
        assert got[cand]["fitness"] == pytest.approx(right, abs=1.01 / (~train).sum())
        assert got[cand]["n_features"] == len(cols)


def test_evolution_of_linear_candidates_frees_its_tables(spark, data):
    vectors, labels = data
    with Scratch() as made:
        found = evolve.evolve(vectors, labels, 12, num_iterations=2, population_size=4, elite=0.25, classifier="svm", alphas=(0.1, 1.0))
        assert found.best > 0.4
        assert found.best_features.count() > 0 and found.rounds.select("round").distinct().count() >= 1
    assert not made.kept
    with pytest.raises(ValueError):
        evolve.evolve(vectors, labels, 12, classifier="knn")


def test_scratch_deletes_all_but_the_kept(spark):
    with Scratch() as made:
        kept, gone = stage(spark.range(3).toDF("x")), stage(spark.range(4).toDF("x"))
        made.keep(kept)
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone._path).count()


def test_null_labels_and_empty_tables(spark, data):
    vectors, labels = data
    order, rows = many.coded(labels.withColumn("label", F.when(F.col("doc_id") % 2 == 0, F.col("label"))))
    half = many.fit_many(many.packed_rows(vectors, rows), 12, [many.LinearSpec(0)])
    _, kept = many.coded(labels.filter("doc_id % 2 = 0"))
    alone = many.fit_many(many.packed_rows(vectors, kept), 12, [many.LinearSpec(0)])
    assert half.weights == pytest.approx(alone.weights, abs=1e-6)
    _, none = many.coded(labels.limit(0).withColumn("label", F.lit("a")))
    assert not many.fit_many(many.packed_rows(vectors, none), 12, [many.LinearSpec(0)]).weights.any()

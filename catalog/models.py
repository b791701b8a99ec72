"""Queries: classifiers and what they learned."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FOLDS, LANG, PREDICTED, QUALITY, SOURCE, bayes, coo, docs, folded_bayes, folds, lang, quality, query, r6, shared, six, source, table, unit, whole, words
from catalog.vectors import length, vectors
from sorrel.operators import folds as cv, instances, learners, naive_bayes as nb, neighbours, ngrams, ordinal, perceptron, weights
from sorrel.operators.baseline import random_baseline
from sorrel.operators.folds import make_folds
from sorrel.plans import search
from sorrel.plans.staging import stage, staging_root
from sorrel.sources import storage


# -------------------------------------------------------------- labels and chance


@query("label_index", f"WITH {SOURCE} SELECT doc_id, label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code FROM lab")
def label_index(spark, sf):
    return instances.label_index(source(spark, sf)).select("doc_id", "label", "code")


@query("label_inverse", f"WITH {SOURCE} SELECT doc_id, label FROM lab")
def label_inverse(spark, sf):
    labels = source(spark, sf)
    codes = instances.label_index(labels).drop("label")
    return instances.label_inverse(codes, instances.label_table(labels)).select("doc_id", "label")


def _random_sql(lab: str, weighted: bool) -> str:
    share = "n" if weighted else "1"
    return (
        f"WITH {lab}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY label), "
        f"b AS (SELECT label, (sum({share}) OVER (ORDER BY label))::DOUBLE / (sum({share}) OVER ())::DOUBLE AS hi, "
        f"(sum({share}) OVER (ORDER BY label) - {share})::DOUBLE / (sum({share}) OVER ())::DOUBLE AS lo FROM c), "
        f"u AS (SELECT doc_id, {unit(42, 'doc_id')} AS u FROM documents) "
        "SELECT doc_id, label AS prediction FROM u JOIN b ON u >= lo AND u < hi"
    )


@query("random_equal", _random_sql(LANG, False))
def random_equal(spark, sf):
    return random_baseline(docs(spark, sf), lang(spark, sf))


@query("random_weighted", _random_sql(SOURCE, True))
def random_weighted(spark, sf):
    return random_baseline(docs(spark, sf), source(spark, sf), "weighted")


@query("class_weights", f"WITH {LANG}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY label) SELECT label, {r6('sum(n) OVER () / (count(*) OVER () * n::DOUBLE)')} AS weight FROM c")
def class_weights(spark, sf):
    chosen = learners.class_weights(lang(spark, sf))
    return six(spark.createDataFrame(sorted(chosen.items()), "label string, weight double"), "weight")


# -------------------------------------------------------------------- naive Bayes


@shared
def quality_model(spark, sf):
    """Trained on the labelled documents, 5000 most frequent words."""
    fitted = weights.fit_vectorizer(words(spark, sf), quality(spark, sf))
    return nb.fit_naive_bayes(fitted.train.drop("feature_id"), fitted.train_labels, vocab_size=fitted.size)


@shared
def quality_scores(spark, sf):
    return stage(six(quality_model(spark, sf).scores(words(spark, sf), docs(spark, sf)), "prob"), "quality_scores")


@query("naive_bayes", f"WITH {coo()}, {QUALITY}, {bayes()} SELECT doc_id, label, prob FROM p")
def naive_bayes(spark, sf):
    return quality_scores(spark, sf)


@query("naive_bayes_prior", f"WITH {coo()}, {QUALITY}, {bayes('0.5', True)} SELECT doc_id, label, prob FROM p")
def naive_bayes_prior(spark, sf):
    fitted = weights.fit_vectorizer(words(spark, sf), quality(spark, sf))
    model = nb.fit_naive_bayes(fitted.train, fitted.train_labels, 0.5, True, fitted.size)
    return six(model.scores(words(spark, sf), docs(spark, sf)), "prob")


@query("predictions", f"WITH {coo()}, {QUALITY}, {bayes()}, {PREDICTED} SELECT doc_id, prediction FROM pred")
def predictions(spark, sf):
    return instances.predictions(quality_scores(spark, sf))


@query("naive_bayes_saved_and_loaded", f"WITH {coo()}, {QUALITY}, {bayes()} SELECT doc_id, label, prob FROM p")
def naive_bayes_saved_and_loaded(spark, sf):
    path = f"{staging_root(spark)}/model"
    storage.save_model(quality_model(spark, sf), path, spark)
    loaded = storage.load_model(path, spark)
    return six(loaded.scores(words(spark, sf), docs(spark, sf)), "prob")


@query(
    "roc_auc",
    f"WITH {coo()}, {QUALITY}, {bayes()}, told AS (SELECT p.label, prob, (p.label = lab.label)::INT AS hit FROM p JOIN lab USING (doc_id)), "
    "ranks AS (SELECT label, hit, rank() OVER (PARTITION BY label ORDER BY prob) + (count(*) OVER (PARTITION BY label, prob) - 1) / 2.0 AS place FROM told) "
    f"SELECT label, {r6('(sum(place) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * sum(1 - hit))')} AS auc FROM ranks GROUP BY label",
)
def roc_auc(spark, sf):
    scores = quality_scores(spark, sf).withColumn("setting", F.lit(0))
    return six(search.label_auc(scores, quality(spark, sf)), "auc").select("label", "auc")


ALPHA = f"""
WITH {coo()}, {LANG}, {FOLDS}, {folded_bayes()}, al AS (SELECT 2.0::DOUBLE * unnest(range(1, 20)) / 19 AS alpha),
sa AS (SELECT alpha, x.f, x.doc_id, t.label, sum(x.value * (ln(coalesce(c.n, 0) + alpha) - ln(t.t + alpha * vs.v))) AS s FROM test x JOIN tot t USING (f) JOIN vs USING (f)
  CROSS JOIN al LEFT JOIN cnt c ON c.f = x.f AND c.label = t.label AND c.feature = x.feature GROUP BY ALL),
ra AS (SELECT al.alpha, o.fold, o.doc_id, lab.label AS target, l.label, row_number() OVER (PARTITION BY al.alpha, o.doc_id ORDER BY coalesce(s.s, 0) + l.prior DESC, l.label) AS r
  FROM folds o JOIN lab USING (doc_id) JOIN pri l ON l.f = o.fold CROSS JOIN al LEFT JOIN sa s ON s.f = l.f AND s.doc_id = o.doc_id AND s.label = l.label AND s.alpha = al.alpha),
fa AS (SELECT alpha, fold, avg((target = label)::INT) AS a FROM ra WHERE r = 1 GROUP BY ALL)
SELECT {r6('alpha')} AS alpha, {r6('avg(a)')} AS accuracy FROM fa GROUP BY alpha
"""


@query("naive_bayes_alpha_search", ALPHA)
def naive_bayes_alpha_search(spark, sf):
    return six(cv.FoldedBayes(words(spark, sf), lang(spark, sf), folds(spark, sf)).alpha_scores(), "alpha", "accuracy")


BAYES = f"WITH {coo()}, {QUALITY}, {bayes()}"


@query("nb_feature_count", f"{BAYES} SELECT 'tokens' AS ftype, feature, label, n FROM w")
def nb_feature_count(spark, sf):
    return nb.feature_count(quality_model(spark, sf))


@query("nb_feature_log_prob", f"{BAYES} SELECT 'tokens' AS ftype, feature, {r6('''max(CASE WHEN label = '0' THEN w END)''')} AS \"0\", {r6('''max(CASE WHEN label = '1' THEN w END)''')} AS \"1\" FROM w GROUP BY feature")
def nb_feature_log_prob(spark, sf):
    model = quality_model(spark, sf)
    return six(nb.pivot_labels(nb.feature_log_prob(model), "log_prob", model.labels), "0", "1")


@query("nb_ranked_features", f"{BAYES} SELECT label, 'tokens' AS ftype, feature, {r6('w')} AS log_prob, row_number() OVER (PARTITION BY label ORDER BY n DESC, feature) AS rank FROM w")
def nb_ranked_features(spark, sf):
    return whole(six(nb.ranked_features(quality_model(spark, sf)), "log_prob"), "rank")


@query(
    "nb_top_features",
    f"{BAYES}, r AS (SELECT label, 'tokens' AS ftype, feature, {r6('w')} AS log_prob, row_number() OVER (PARTITION BY label ORDER BY n DESC, feature) AS rank FROM w) SELECT * FROM r WHERE rank <= 50",
)
def nb_top_features(spark, sf):
    return whole(six(nb.ranked_features(quality_model(spark, sf), 50), "log_prob"), "rank")


@query("nb_classes", f"WITH {QUALITY} SELECT label, count(*) AS n, {r6('-ln(2)')} AS log_prior FROM lab GROUP BY label")
def nb_classes(spark, sf):
    return six(nb.class_table(quality_model(spark, sf), spark), "log_prior")


# ------------------------------------------------------------------ k nearest rows


@shared
def dense(spark, sf):
    """Embeddings as numbered columns with labels and five folds."""
    rows = vectors(spark, sf).withColumn("feature_id", F.col("feature").substr(F.lit(2), F.length("feature")).cast("int"))
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label"))
    parts = stage(make_folds(labels, 5), "folds").select("doc_id", "fold")
    return stage(rows, "dense"), stage(labels.join(parts, "doc_id"), "dense_labels")


KNN = f"""
WITH e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label::VARCHAR AS label, (row_number() OVER (ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings),
d AS (SELECT a.doc_id, b.doc_id AS neighbour, b.label, {{metric}} AS distance FROM e a JOIN e b ON a.fold <> b.fold),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, neighbour) AS place FROM d), k AS (SELECT * FROM r WHERE place <= {{k}}),
labs AS (SELECT DISTINCT label FROM e)
"""
EUCLID = "list_distance(a.v, b.v)"
MANHATTAN = "list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])))"
MINKOWSKI = "power(list_sum(list_transform(list_zip(a.v, b.v), lambda x: power(abs(x[1] - x[2]), 3))), 1.0 / 3)"
VOTE = (
    "SELECT i.doc_id, l.label, {w} AS prob FROM (SELECT doc_id, sum({v}) AS s FROM k GROUP BY doc_id) i CROSS JOIN labs l "
    "LEFT JOIN (SELECT doc_id, label, sum({v}) AS n FROM k GROUP BY ALL) x ON x.doc_id = i.doc_id AND x.label = l.label"
)


def _nearest(spark, sf, k, metric, p=2.0):
    rows, labels = dense(spark, sf)
    return neighbours.nearest(rows, labels, rows, labels.drop("label"), 64, k, metric, p)


def _near_sql(metric: str, k: int = 3) -> str:
    return f"{KNN.format(metric=metric, k=k)} SELECT doc_id, neighbour, label, {r6('distance')} AS distance, place FROM k"


@query("knn_neighbours", _near_sql(EUCLID, 5))
def knn_neighbours(spark, sf):
    return whole(six(_nearest(spark, sf, 5, "euclidean"), "distance"), "place")


@query("knn_neighbours_manhattan", _near_sql(MANHATTAN))
def knn_neighbours_manhattan(spark, sf):
    return whole(six(_nearest(spark, sf, 3, "manhattan"), "distance"), "place")


@query("knn_neighbours_minkowski", _near_sql(MINKOWSKI))
def knn_neighbours_minkowski(spark, sf):
    return whole(six(_nearest(spark, sf, 3, "minkowski", 3.0), "distance"), "place")


@query("knn_uniform", f"{KNN.format(metric=EUCLID, k=3)} {VOTE.format(v='1', w=r6('coalesce(n, 0) / s::DOUBLE'))}")
def knn_uniform(spark, sf):
    order = instances.label_list(dense(spark, sf)[1])
    return six(neighbours.vote(_nearest(spark, sf, 3, "euclidean"), order), "prob")


@query("knn_distance", f"{KNN.format(metric=EUCLID, k=5)} {VOTE.format(v='1.0 / distance', w=r6('coalesce(n, 0) / s::DOUBLE'))}")
def knn_distance(spark, sf):
    order = instances.label_list(dense(spark, sf)[1])
    return six(neighbours.vote(_nearest(spark, sf, 5, "euclidean"), order, "distance"), "prob")


# ------------------------------------------------------------- numeric predictions


@shared
def chosen_words(spark, sf):
    """200 most frequent words as numbered columns, all documents."""
    picked = stage(weights.prune_top_k(ngrams.word_totals(docs(spark, sf), lowercase=True), 200), "picked")
    return picked, ngrams.chosen_word_counts(docs(spark, sf), picked, lowercase=True)


@query("linear_regression")
def linear_regression(spark, sf):
    _, rows = chosen_words(spark, sf)
    model = learners.linear_regression(rows, length(spark, sf), 200)
    return six(model.predict(rows, docs(spark, sf)), "prediction")


@query("nearest_ordinal", "SELECT o_orderkey AS doc_id, trunc(o_totalprice / 100000)::INT AS prediction FROM orders")
def nearest_ordinal(spark, sf):
    numbers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") / 100000).alias("prediction"))
    return ordinal.nearest_ordinal(numbers)


RANGES = (
    "span AS (SELECT label, min(y) AS lo, max(y) AS hi FROM tr GROUP BY label), "
    "ranges AS (SELECT label, coalesce(lag(hi) OVER o, '-inf'::DOUBLE) AS lower, CASE WHEN lead(label) OVER o IS NULL THEN 'inf'::DOUBLE ELSE hi END AS upper "
    "FROM span WINDOW o AS (ORDER BY lo, hi, label))"
)
BANDS = "tr AS (SELECT CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS label, l_quantity AS y FROM lineitem)"


def _bands(spark, sf):
    q = F.col("l_quantity")
    label = F.when(q <= 10, "small").when(q <= 30, "medium").otherwise("large")
    return table(spark, sf, "lineitem").select(label.alias("label"), q.alias("label_num"))


@query("label_ranges", f"WITH {BANDS}, {RANGES} SELECT label, lower, upper FROM ranges")
def label_ranges(spark, sf):
    return ordinal.label_ranges(_bands(spark, sf)).drop("place")


@query("translate_numeric", f"WITH {BANDS}, {RANGES}, e AS (SELECT event_id AS doc_id, value AS x FROM events) SELECT doc_id, x AS number, label AS prediction FROM e LEFT JOIN ranges ON x > lower AND x <= upper")
def translate_numeric(spark, sf):
    numbers = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("value").alias("prediction"))
    return ordinal.translate_numeric(numbers, _bands(spark, sf))


# ------------------------------------------------------------------ Spark ML learners


def _train(spark, sf):
    picked, rows = chosen_words(spark, sf)
    return picked, rows, quality(spark, sf).select("doc_id", "label")


def _scored(learner, spark, sf):
    return six(learner.scores(chosen_words(spark, sf)[1], docs(spark, sf)), "prob")


@shared
def svm_model(spark, sf):
    _, rows, labels = _train(spark, sf)
    return learners.linear_svm(rows, labels, 200, max_iter=20)


@query("linear_svm")
def linear_svm(spark, sf):
    return _scored(svm_model(spark, sf), spark, sf)


@query("svm_margins")
def svm_margins(spark, sf):
    from sorrel.operators.instances import sparse_instances

    every = sparse_instances(chosen_words(spark, sf)[1], docs(spark, sf).select("doc_id"), 200)
    return six(svm_model(spark, sf).margins(every), "_0").withColumnRenamed("_0", "margin")


@query("kernel_svm_rbf")
def kernel_svm_rbf(spark, sf):
    rows, labels = dense(spark, sf)
    model = learners.kernel_svm(rows, labels.select("doc_id", F.when(F.col("label") < "5", "low").otherwise("high").alias("label")), 64, "rbf", 0.1, max_iter=20)
    return six(model.scores(rows, labels), "prob")


@query("kernel_svm_poly")
def kernel_svm_poly(spark, sf):
    picked = stage(weights.prune_top_k(words(spark, sf), 20), "picked")
    rows = stage(weights.select_features(words(spark, sf), picked), "rows")
    model = learners.kernel_svm(rows, quality(spark, sf).select("doc_id", "label"), 20, "poly", degree=2, max_iter=20)
    return six(model.scores(rows, docs(spark, sf)), "prob")


@shared
def logistic_model(spark, sf):
    _, rows = chosen_words(spark, sf)
    return learners.logistic_regression(rows, lang(spark, sf), 200, max_iter=30)


@query("logistic_regression")
def logistic_regression(spark, sf):
    return _scored(logistic_model(spark, sf), spark, sf)


@query("logistic_regression_l1")
def logistic_regression_l1(spark, sf):
    _, rows = chosen_words(spark, sf)
    return _scored(learners.logistic_regression(rows, lang(spark, sf), 200, penalty="l1", multiclass="multinomial", max_iter=30), spark, sf)


@shared
def boosted_model(spark, sf):
    _, rows, labels = _train(spark, sf)
    return learners.boosted_trees(rows, labels, 200)


@query("boosted_trees")
def boosted_trees(spark, sf):
    return _scored(boosted_model(spark, sf), spark, sf)


@query("decision_tree")
def decision_tree(spark, sf):
    _, rows, labels = _train(spark, sf)
    return _scored(learners.decision_tree(rows, labels, 200, "balanced", 5), spark, sf)


@query("random_forest")
def random_forest(spark, sf):
    _, rows = chosen_words(spark, sf)
    return _scored(learners.random_forest(rows, lang(spark, sf), 200, 20, 5), spark, sf)


@query("perceptron")
def perceptron_(spark, sf):
    _, rows = chosen_words(spark, sf)
    return perceptron.fit_perceptron(rows, lang(spark, sf), 200, iterations=3).scores(rows, docs(spark, sf))


def _searched(spark, scored):
    rows = [(str(sorted(settings.items())), float(score)) for settings, score in scored]
    return six(spark.createDataFrame(rows, "settings string, score double"), "score")


@query("grid_search")
def grid_search(spark, sf):
    _, rows, labels = _train(spark, sf)
    _, scored, _ = learners.search(rows, labels, 200, {"c": [0.01, 1, 100], "penalty": ["l2"]}, folds=3, scoring="roc_auc")
    return _searched(spark, scored)


@query("random_search")
def random_search(spark, sf):
    _, rows, labels = _train(spark, sf)
    _, scored, _ = learners.search(rows, labels, 200, learners.SEARCH["logistic_regression"], n_iter=3, folds=3)
    return _searched(spark, scored)


@query("linear_weights")
def linear_weights(spark, sf):
    return six(learners.linear_weights(logistic_model(spark, sf), chosen_words(spark, sf)[0]), "weight")


@query("feature_importance")
def feature_importance(spark, sf):
    return six(learners.feature_importance(boosted_model(spark, sf), chosen_words(spark, sf)[0]), "importance")


@query("parameter_settings")
def parameter_settings(spark, sf):
    return learners.parameter_settings(boosted_model(spark, sf), spark)


@query("learner_saved_and_loaded")
def learner_saved_and_loaded(spark, sf):
    path = f"{staging_root(spark)}/learner"
    storage.save_model(logistic_model(spark, sf), path, spark)
    return _scored(storage.load_model(path, spark), spark, sf)

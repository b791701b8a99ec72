"""Folds, classifiers, reports, stacking and evolution."""

import math
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sorrel.operators import evolve, folds as cv, learners, naive_bayes as nb, neighbours, ordinal, perceptron, report, stacking, weights
from sorrel.operators.instances import predictions
from sorrel.plans import pipeline, search
from sorrel.plans.settings import Append, Evolution, Features, Folds, Settings, Text, Vectors
from sorrel.plans.staging import stage
from sorrel.sources import storage


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, label string")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    own = {"a": "red rose garden".split(), "b": "blue sky cloud".split(), "c": "green leaf tree".split()}
    rows = []
    for i in range(90):
        label = "abc"[i % 3] if i % 7 else rng.choice("abc")
        words = [rng.choice(own[label] + ["the", "of", "and"]) for _ in range(rng.randint(3, 12))]
        rows.append((i, " ".join(words) + ".", label))
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    return docs.select("doc_id", "text"), docs.select("doc_id", "label")


PLAIN = Settings(text=Text(False, True), features=Features(ngrams=(1,)), folds=Folds(n=3))


def test_folds_in_blocks(spark):
    ids = spark.range(10).withColumnRenamed("id", "doc_id")
    got = [r["fold"] for r in cv.make_folds(ids, 2, 2).orderBy("doc_id").collect()]
    assert got == [0, 0, 1, 1, 0, 0, 1, 1, 0, 0]
    some = [r["fold"] for r in cv.make_folds(ids, 2, 1, 2, 8).orderBy("doc_id").collect()]
    assert some == [-1, -1, 0, 1, 0, 1, 0, 1, -1, -1]


@pytest.mark.parametrize("prune", [None, 6])
@pytest.mark.parametrize("prior", [False, True])
def test_all_folds_at_once_agree_with_one_fit_per_fold(spark, corpus, prune, prior):
    docs, l = corpus
    f = pipeline.featurize(docs, PLAIN)
    folds = stage(cv.make_folds(docs, 3, 1, 6, 80))
    once = cv.FoldedBayes(f, l, folds, prune, prior).scores()
    settings = Settings(vectors=Vectors(prune=prune), options={"naive_bayes": {"fit_prior": prior}})
    each = cv.cross_validate(f, l, folds, pipeline.trainer(settings))
    a = {tuple(r)[:3]: r["prob"] for r in once.select("fold", "doc_id", "label", "prob").collect()}
    b = {tuple(r)[:3]: r["prob"] for r in each.collect()}
    assert len(a) == 74 * 3 and a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("lone", [0, 60])
def test_only_features_that_a_fold_can_keep_are_counted_by_label(spark, lone, monkeypatch):
    """Rare words get no counts by label, unless words of a single fold hold the first places."""
    rng = random.Random(5)
    cells = [(d, "t", f"w{w}", float(1 + (w < 8) * 20 + rng.randint(0, 2))) for d in range(30) for w in range(40) if w < 8 or rng.random() < 0.2]
    cells += [(3 * (i % 10), "t", f"lone{i}", 500.0) for i in range(lone)]
    f = stage(spark.createDataFrame(cells, "doc_id long, ftype string, feature string, value double"))
    l = labels(spark, ["a" if i % 2 else "b" for i in range(30)])
    folds = stage(cv.make_folds(l, 3))
    counted = []
    count = nb.label_counts
    monkeypatch.setattr(nb, "label_counts", lambda rows, *args: counted.append(rows.select("feature").distinct().count()) or count(rows, *args))
    once = cv.FoldedBayes(f, l, folds, 6).scores()
    assert counted[0] == 12 and (len(counted) == 1) == (lone == 0)
    each = cv.cross_validate(f, l, folds, pipeline.trainer(Settings(vectors=Vectors(prune=6))))
    a = {tuple(r)[:3]: r["prob"] for r in once.select("fold", "doc_id", "label", "prob").collect()}
    b = {tuple(r)[:3]: r["prob"] for r in each.collect()}
    assert len(a) == 60 and a == pytest.approx(b, abs=1e-9)


def test_a_label_missing_from_a_fold_gets_probability_zero(spark, corpus):
    docs, _ = corpus
    l = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y").alias("label"))
    scores = cv.FoldedBayes(pipeline.featurize(docs, PLAIN), l, stage(cv.make_folds(docs, 3))).scores()
    assert scores.filter("fold = 0 and label = 'x'").agg(F.max("prob")).first()[0] == 0.0


def test_alpha_search_agrees_with_separate_runs(spark, corpus):
    docs, l = corpus
    folded = cv.FoldedBayes(pipeline.featurize(docs, PLAIN), l, stage(cv.make_folds(docs, 3)))
    got = {round(r["alpha"], 6): r["accuracy"] for r in folded.alpha_scores((0.3, 1.0)).collect()}
    for alpha, accuracy in got.items():
        pairs = predictions(folded.scores(alpha)).join(l, "doc_id")
        per = pairs.groupBy("fold").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a"))
        assert accuracy == pytest.approx(per.agg(F.avg("a")).first()[0])


def test_performance_with_a_label_never_predicted(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "target string, prediction string")
    got = {r["label"]: r for r in report.performance(pairs).collect()}
    assert got["c"]["pr"] == 0.0 and got["c"]["tot"] == 1 and got["c"]["clf"] == 0
    assert got["b"]["pr"] == pytest.approx(1 / 3) and got["b"]["re"] == 1.0 and got["b"]["fpr"] == pytest.approx(2 / 3)
    assert got["micro"]["pr"] == 0.5 and got["micro"]["cor"] == 2


def test_top_k_hit_and_numeric_ranking(spark):
    scores = spark.createDataFrame(
        [(0, "a", 0.5), (0, "b", 0.3), (0, "c", 0.2), (1, "a", 9e-05), (1, "b", 0.5), (1, "c", 0.4)], "doc_id long, label string, prob double"
    )
    targets = spark.createDataFrame([(0, "c"), (1, "b")], "doc_id long, label string")
    right = lambda k: report.pairs_at_k(scores, targets, k).filter("target = prediction").count()
    assert (right(1), right(3)) == (1, 2)
    tn = report.ranked_outcomes(scores, targets, "b").orderBy("prob", ascending=False).collect()
    assert [(r["doc_id"], r["outcome"]) for r in tn] == [(1, "tp"), (0, "tn")]


def test_ordinal_report(spark):
    pairs = spark.createDataFrame([("1", "1"), ("1", "3"), ("2", "2"), ("3", "1")], "target string, prediction string")
    got = {r["label"]: r for r in report.ordinal_performance(pairs).collect()}
    assert got["1"]["mae"] == 1.0 and got["1"]["rmse"] == pytest.approx(math.sqrt(2))
    assert got["overall"]["mae"] == 1.0 and got["overall"]["acc"] == 0.5 and got["1"]["acc"] == 0.5


def test_numbers_to_labels_on_edges_and_outside(spark):
    train = spark.createDataFrame([("lo", 1.0), ("lo", 2.0), ("hi", 3.0), ("hi", 9.0)], "label string, label_num double")
    numbers = spark.createDataFrame([(0, -5.0), (1, 2.0), (2, 2.5), (3, 99.0)], "doc_id long, prediction double")
    got = [r["prediction"] for r in ordinal.translate_numeric(numbers, train).orderBy("doc_id").collect()]
    assert got == ["lo", "lo", "hi", "hi"]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "minkowski", "hamming"])
def test_neighbours_against_brute_force(spark, metric):
    rng = random.Random(1)
    points = [[rng.randint(0, 3) for _ in range(4)] for _ in range(50)]
    rows = [(i, j, float(v)) for i, p in enumerate(points) for j, v in enumerate(p) if v]
    vectors = spark.createDataFrame(rows, "doc_id long, feature_id int, value double")
    l = labels(spark, [rng.choice("ab") for _ in points])
    docs = l.filter("doc_id >= 40").select("doc_id")
    got = neighbours.nearest(vectors, l.filter("doc_id < 40"), vectors, docs, 4, 3, metric, 3.0, train_block=7, test_block=4)
    dist = {
        "euclidean": lambda a, b: math.dist(a, b),
        "manhattan": lambda a, b: sum(abs(x - y) for x, y in zip(a, b)),
        "minkowski": lambda a, b: sum(abs(x - y) ** 3 for x, y in zip(a, b)) ** (1 / 3),
        "hamming": lambda a, b: sum(x != y for x, y in zip(a, b)) / 4,
    }[metric]
    near = {}
    for r in got.orderBy("doc_id", "place").collect():
        near.setdefault(r["doc_id"], []).append(r["neighbour"])
    for i in range(40, 50):
        assert near[i] == sorted(range(40), key=lambda j: (round(dist(points[i], points[j]), 9), j))[:3]


def test_votes_by_count_and_distance(spark):
    rows = [(0, 1, "b", 0.0), (0, 2, "a", 0.1), (0, 3, "a", 0.1), (1, 2, "a", 2.0), (1, 3, "b", 2.0)]
    near = spark.createDataFrame(rows, "doc_id long, neighbour long, label string, distance double")
    pick = lambda w: {r["doc_id"]: r["prediction"] for r in predictions(neighbours.vote(near, ["a", "b"], w)).collect()}
    assert pick("uniform") == {0: "a", 1: "a"} and pick("distance") == {0: "b", 1: "a"}


def test_every_classifier_learns_the_corpus(spark, corpus):
    docs, l = corpus
    f = pipeline.featurize(docs, PLAIN)
    train, test = l.filter("doc_id < 60"), l.filter("doc_id >= 60")
    options = {"svm": {"max_iter": 10, "cv": 2}, "logistic_regression": {"max_iter": 20}, "xgboost": {"n_estimators": 3, "max_depth": 3}}
    for name in ("naive_bayes", "knn", "perceptron", "svm", "logistic_regression", "xgboost", "tree", "random_forest"):
        settings = Settings(classifier=name, options=options)
        scores = stage(pipeline.trainer(settings)(f, train, f, test.select("doc_id")))
        right = predictions(scores).join(test, "doc_id").filter("prediction = label").count()
        assert right >= 20, name
        total = scores.groupBy("doc_id").agg(F.sum("prob").alias("p")).agg(F.min("p"), F.max("p")).first()
        assert total[0] == pytest.approx(1.0) and total[1] == pytest.approx(1.0)


def test_labels_are_fitted_side_by_side(spark):
    table = spark.createDataFrame([(i, float(i % 3)) for i in range(9)], "doc_id long, code double")
    together = threading.Barrier(3)

    def fit(rows):
        together.wait(timeout=60)
        return sorted(r["doc_id"] for r in rows.filter("code = 1.0").collect())

    assert learners.one_vs_rest(table, ["a", "b", "c"], 1, fit).models == [[0, 3, 6], [1, 4, 7], [2, 5, 8]]
    assert learners.one_vs_rest(table, [], 1, fit).models == []


def test_class_weights(spark):
    assert learners.class_weights(labels(spark, "aaab")) == {"a": pytest.approx(4 / 6), "b": 2.0}
    assert learners.class_weights(labels(spark, "ab"), {"a": 5}) == {"a": 5.0, "b": 1.0}


def test_models_survive_storage(spark, corpus, tmp_path):
    docs, l = corpus
    f = pipeline.featurize(docs, PLAIN)
    fitted = weights.fit_vectorizer(f, l)
    vectors = weights.apply_vectorizer(fitted, f)
    for i, model in enumerate([nb.fit_naive_bayes(fitted.train, l), learners.decision_tree(vectors, l, fitted.size)]):
        storage.save_model(model, str(tmp_path / str(i)), spark)
        back = storage.load_model(str(tmp_path / str(i)), spark)
        assert sorted(map(tuple, back.scores(vectors, docs).collect())) == sorted(map(tuple, model.scores(vectors, docs).collect()))


def test_reports_are_written(spark, tmp_path):
    table = spark.createDataFrame([("a", 0.12345, 3)], "label string, pr double, tot long")
    storage.write_report_csv(table, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["pr"] == "0.12"
    storage.write_report_txt(table, str(tmp_path / "txt"), "|")
    assert spark.read.text(str(tmp_path / "txt")).first()["value"] == "a|0.12345|3"


def test_balanced_training_sees_every_copy(spark, corpus):
    docs, l = corpus
    few = l.filter("label <> 'c' or doc_id < 20")
    fitted = weights.fit_vectorizer(pipeline.featurize(docs, PLAIN), few, balanced=True)
    model = nb.fit_naive_bayes(fitted.train, fitted.train_labels, vocab_size=fitted.size)
    assert len(set(model.label_docs)) == 1


def test_stacking_and_appending(spark, corpus):
    docs, l = corpus
    f = pipeline.featurize(docs, PLAIN)
    train, test = l.filter("doc_id < 60"), l.filter("doc_id >= 60")
    base = {n: pipeline.trainer(Settings(), n) for n in ("naive_bayes", "tree")}
    scores = stacking.stack_ensemble(base, pipeline.trainer(Settings(classifier="tree")), f, train, f, test.select("doc_id"), 2)
    assert predictions(scores).join(test, "doc_id").filter("prediction = label").count() >= 20
    extra = docs.select("doc_id", F.lit("csv").alias("ftype"), F.lit("len").alias("feature"), F.length("text").cast("double").alias("value"))
    joined = stacking.append_trainer(pipeline.trainer(Settings()), extra, pipeline.trainer(Settings()), 2, probs=True)
    assert joined(f, train, f, test.select("doc_id")).count() == 90


def test_whole_run_in_folds(spark, corpus):
    docs, l = corpus
    out = pipeline.run_pipeline(docs, l, settings=PLAIN)
    assert out["performance"].filter("label = 'micro'").first()["tot"] == 90
    assert out["fold_summary"].filter("label = 'micro'").first()["tot"] == 90
    assert "performance_at_3" in out


def test_population_is_bred_without_empty_children(spark):
    population = stage(evolve.random_population(spark, 12, 6))
    scored = spark.createDataFrame([(i, 0.1 * i, 5, 0.1 * i) for i in range(6)], "cand_id long, fitness double, n_features long, weighted double")
    parents = evolve.select_parents(scored, "f1_micro", 3, 1)
    assert parents.filter("cand_id = 5").count() == 0 and parents.count() == 6
    children = evolve.mutate(evolve.crossover(population, parents, 12), 6, 12)
    assert children.select("child").distinct().count() == 6
    lone = spark.createDataFrame([(0, 0)], "child long, feature_id int")
    assert evolve.mutate(lone, 2, 1, 0.5).select("child").distinct().count() == 2


def test_candidates_are_scored_like_the_classifier(spark, corpus):
    docs, l = corpus
    fitted = weights.fit_vectorizer(pipeline.featurize(docs, PLAIN), l)
    sample = evolve.train_test_sample(l, 0.6)
    problem = evolve.prepare(fitted.train, sample, fitted.size)
    population = evolve.random_population(spark, fitted.size, 4)
    params = spark.createDataFrame([(i, 1.0) for i in range(4)], "cand_id long, alpha double")
    got = {r["cand_id"]: r["fitness"] for r in evolve.score_candidates(problem, population, params).collect()}
    for cand, fitness in got.items():
        mask = population.filter(F.col("cand_id") == cand)
        rows = fitted.train.join(mask, "feature_id", "left_semi")
        model = nb.fit_naive_bayes(rows, sample.filter("train").select("doc_id", "label"), vocab_size=mask.count())
        held = sample.filter("not train")
        right = predictions(model.scores(rows, held)).join(held, "doc_id").filter("prediction = label").count()
        assert fitness == pytest.approx(right / held.count())


def test_evolution_stops_and_reports(spark, corpus):
    docs, l = corpus
    fitted = weights.fit_vectorizer(pipeline.featurize(docs, PLAIN), l)
    found = evolve.evolve(fitted.train, l, fitted.size, num_iterations=2, population_size=6, alphas=(0.5, 1.0), elite=0.2)
    assert found.best > 0.5 and 1 <= evolve.evolution_report(found.rounds).count() <= 3


def test_perceptron_averages_its_shards(spark, corpus):
    docs, l = corpus
    fitted = weights.fit_vectorizer(pipeline.featurize(docs, PLAIN), l)
    model = perceptron.fit_perceptron(fitted.train, l, fitted.size, 5, shard_rows=30)
    right = predictions(model.scores(fitted.train, docs)).join(l, "doc_id").filter("prediction = label").count()
    assert right > 80


def test_perceptron_does_not_depend_on_partitions(spark, corpus):
    docs, l = corpus
    fitted = weights.fit_vectorizer(pipeline.featurize(docs, PLAIN), l)
    found = []
    for size, parts in (("4k", "3"), ("128m", "8")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(perceptron.fit_perceptron(fitted.train, l, fitted.size, 4, shard_rows=25).weights)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert np.allclose(*found) and found[0].any()


def test_perceptron_penalty_shrinks_weights(spark, corpus):
    docs, l = corpus
    fitted = weights.fit_vectorizer(pipeline.featurize(docs, PLAIN), l)
    plain, small = (perceptron.fit_perceptron(fitted.train, l, fitted.size, 3, alpha=0.05, penalty=p).weights for p in (None, "l2"))
    assert np.abs(small[:, :-1]).sum() < np.abs(plain[:, :-1]).sum()


def test_perceptron_and_regression_survive_storage(spark, corpus, tmp_path):
    docs, l = corpus
    fitted = weights.fit_vectorizer(pipeline.featurize(docs, PLAIN), l)
    model = perceptron.fit_perceptron(fitted.train, l, fitted.size, 2)
    storage.save_model(model, str(tmp_path / "p"), spark)
    assert (storage.load_model(str(tmp_path / "p"), spark).weights == model.weights).all()
    numeric = pipeline.numeric_labels(l.withColumn("label", F.ascii("label").cast("string")))
    line = learners.linear_regression(fitted.train, numeric, fitted.size)
    storage.save_model(line, str(tmp_path / "r"), spark)
    back = storage.load_model(str(tmp_path / "r"), spark)
    assert sorted(map(tuple, back.predict(fitted.train, docs).collect())) == sorted(map(tuple, line.predict(fitted.train, docs).collect()))


def test_scaling_follows_pruning(spark, corpus):
    docs, l = corpus
    f = pipeline.featurize(docs, PLAIN)
    plain, scaled = (
        pipeline.prepare(Settings(vectors=Vectors(prune=10, scale=s, min_scale=m)), "naive_bayes", f, l) for s, m in ((False, 0.0), (True, -1.0))
    )
    names = [{r["feature"] for r in x.vectorizer.selection.collect()} for x in (plain, scaled)]
    assert names[0] == names[1] and len(names[0]) == 10
    values = scaled.vectorizer.train.agg(F.min("value"), F.max("value")).first()
    assert values[0] == -1.0 and values[1] == 1.0
    again = pipeline.transform(scaled, f, docs.select("doc_id"), Settings(vectors=Vectors(prune=10, scale=True, min_scale=-1.0)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scaled.vectorizer.train.select(*again.columns).collect()))


def test_evolution_never_sees_the_test_fold(spark, corpus):
    docs, l = corpus
    f = pipeline.featurize(docs, PLAIN)
    settings = Settings(vectors=Vectors(prune=12), evolution=Evolution(ga=True, num_iterations=1, population_size=4))
    train, test = l.filter("doc_id < 60"), l.filter("doc_id >= 60")
    run = pipeline.trainer(settings)
    a = run(f, train, f, test.select("doc_id")).collect()
    b = run(f, train, f, test.withColumn("label", F.lit("a")).select("doc_id")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    fitted = pipeline.prepare(settings, "naive_bayes", f, train)
    assert 1 <= fitted.size <= 12 and fitted.vectorizer.train.agg(F.max("feature_id")).first()[0] < fitted.size


def test_search_hands_its_smoothing_on(spark, corpus):
    docs, l = corpus
    f = pipeline.featurize(docs, PLAIN)
    settings = Settings(
        options={"naive_bayes": {"alpha": [0.5, 2.0]}}, evolution=Evolution(ga=True, num_iterations=1, population_size=4), vectors=Vectors(prune=12, balance=True)
    )
    fitted, model = pipeline.train_full_model(f, l, settings)
    assert fitted.options["alpha"] in (0.5, 2.0) and model.alpha == fitted.options["alpha"]


def test_split_holds_every_label_and_cuts_are_distinct(spark):
    l = labels(spark, "a" * 50 + "b" * 3 + "c")
    sample = evolve.train_test_sample(l, 0.9)
    parts = {(r["label"], r["train"]): r["n"] for r in sample.groupBy("label", "train").agg(F.count("*").alias("n")).collect()}
    assert parts == {("a", True): 45, ("a", False): 5, ("b", True): 2, ("b", False): 1, ("c", False): 1}
    full = spark.createDataFrame([(0, i) for i in range(6)], "cand_id long, feature_id int")
    pairs = spark.createDataFrame([(p, s, s) for p in range(40) for s in (0, 1)], "pair long, side int, cand_id long")
    children = evolve.crossover(full, pairs, 6, points=3, probability=1.0)
    # Parent 0 has all bits and parent 1 none, so a child's runs show its cuts: with three distinct ones four runs, the first perhaps empty.
    for r in children.groupBy("child").agg(F.sort_array(F.collect_list("feature_id")).alias("ids")).collect():
        bits = [i in r["ids"] for i in range(6)]
        assert sum(a != b for a, b in zip(bits, bits[1:])) >= 2


def test_pairs_that_are_not_crossed_stay_as_they_are(spark):
    population = stage(evolve.random_population(spark, 12, 6))
    pairs = spark.createDataFrame([(p, s, 2 * p + s) for p in range(3) for s in (0, 1)], "pair long, side int, cand_id long")
    children = evolve.crossover(population, pairs, 12, probability=0.0)
    out = evolve.mutate(children, 6, 12, rate=0.9, probability=0.0)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, population.collect()))


def test_settings_reach_the_pipeline(spark, corpus):
    docs, l = corpus
    settings = Settings(
        text=Text(False, True), features=Features(ngrams=(1,)), folds=Folds(n=2), vectors=Vectors(select="fcbf", select_threshold=0.01),
        evolution=Evolution(ga=True, num_iterations=1, population_size=4), append=Append(bow_as_feature=False),
    )
    out = pipeline.run_pipeline(docs, l, settings=settings)
    assert out["performance"].filter("label = 'micro'").first()["f1"] > 0.5


def test_roc_auc_against_pairs(spark):
    rng = random.Random(3)
    told = [rng.choice("abc") for _ in range(60)]
    rows = [(s, n, c, round(rng.random(), 2)) for s in (0, 1) for n in range(60) for c in "abc"]
    got = {r["setting"]: r["score"] for r in search.roc_auc(spark.createDataFrame(rows, "setting int, doc_id long, label string, prob double"), labels(spark, told)).collect()}
    for s in (0, 1):
        areas = []
        for c in "abc":
            p = {n: x for t, n, label, x in rows if t == s and label == c}
            pairs = [(p[i], p[j]) for i in range(60) for j in range(60) if told[i] == c != told[j]]
            areas.append(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs))
        assert got[s] == pytest.approx(sum(areas) / 3)


@pytest.mark.parametrize("parts", ["1", "8"])
def test_roc_auc_of_tiny_probabilities(spark, parts):
    """A perfect ranking far below any rounding, ties, and runs that cross partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rng = random.Random(8)
    rows, told = [], ["ab"[d % 3 == 0] for d in range(300)]
    for d in range(300):
        rows.append((0, d, "a", 1e-30 if told[d] == "b" else 1e-6))
        rows.append((1, d, "a", rng.choice([0.0, 1e-300, 1e-30, 1e-6, 0.5]) * rng.choice([1, 1, 2])))
    scores = spark.createDataFrame(rows, "setting int, doc_id long, label string, prob double")
    got = {r["setting"]: r["score"] for r in search.roc_auc(scores, labels(spark, told)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    value = {(s, d): p for s, d, _, p in rows}
    for s in (0, 1):
        pairs = [(value[s, a], value[s, b]) for a in range(300) if told[a] == "a" for b in range(300) if told[b] == "b"]
        assert got[s] == pytest.approx(sum((x > y) + (x == y) / 2 for x, y in pairs) / len(pairs))
    assert got[0] == 1.0


def test_settings_are_listed_or_drawn():
    assert len(search.settings_to_try("naive_bayes", search.grid_of("naive_bayes", {"alpha": "search"}), 3, 1)) == 19
    grid = search.grid_of("svm", {"c": "search", "kernel": "search", "degree": 2})
    drawn = search.settings_to_try("svm", grid, 7, 1)
    assert set(grid) == {"c", "kernel"} and len(drawn) == len({tuple(d.items()) for d in drawn}) == 7
    wide = search.grid_of("xgboost", {p: "search" for p in search.VALUES["xgboost"]})
    assert len(search.settings_to_try("xgboost", wide, 10, 1)) == 10
    with pytest.raises(ValueError):
        search.grid_of("tree", {"max_depth": "search"})


@pytest.mark.parametrize(
    "name, options",
    [("naive_bayes", {"alpha": [0.5, 1.5]}), ("knn", {"k": [3, 5], "weights": "distance"}), ("perceptron", {"alpha": [0.001, 0.1], "penalty": "l2", "iterations": 2}),
     ("xgboost", {"max_depth": [2, 3], "n_estimators": 2})],
)
def test_any_classifier_is_searched_from_a_run(spark, corpus, name, options):
    docs, l = corpus
    two = l.filter("label <> 'c'")
    settings = Settings(classifier=name, options={name: options}, iterations=2, scoring="roc_auc", vectors=Vectors(prune=30))
    fitted = pipeline.prepare(settings, name, pipeline.featurize(docs, PLAIN), two)
    for parameter, value in options.items():
        assert fitted.options[parameter] in value if isinstance(value, list) else fitted.options[parameter] == value


@pytest.mark.parametrize("metric, p", [("euclidean", 2.0), ("manhattan", 1.0), ("minkowski", 3.0), ("minkowski", 2.5), ("hamming", 2.0)])
def test_nearest_in_a_block_is_exact(metric, p):
    rng = np.random.default_rng(3)
    train, test = rng.normal(size=(90, 6)), rng.normal(size=(40, 6))
    train[20:40], test[:10], test[10:15] = train[:20], train[20:30], 1e-9 * test[10:15]
    folds, mine, ids = rng.integers(0, 3, 90), rng.integers(0, 3, 40), rng.permutation(90)

    def flat(rows, side):
        cells = {"sizes": pa.array([6] * len(rows)), "ids": pa.array(list(range(6)) * len(rows)), "vals": pa.array(rows.ravel())}
        return {f"{side}_{name}": x for name, x in cells.items()}

    lists = flat(train, "a") | flat(test, "b") | {"a_doc_id": pa.array(ids), "a_fold": pa.array(folds), "b_fold": pa.array(mine)}
    row, near, distance = (x.to_numpy() for x in neighbours._best(lists, 6, 4, metric, p, True))
    whole = neighbours._distances(test, train, metric, p)
    want = [(i, j) for i in range(40) for j in sorted(np.flatnonzero(folds != mine[i]), key=lambda j: (whole[i, j], ids[j]))[:4]]
    assert list(zip(row, near)) == want and np.allclose(distance, [whole[x] for x in want], rtol=1e-14, atol=0)
    if rough := neighbours._rough(test, train, metric, p):
        assert np.abs(rough[0] - whole ** {"euclidean": 2, "manhattan": 1}.get(metric, p)).max() < rough[1] < 1e-2
    assert (rough is None) == (metric == "hamming" or p == 2.5)


@pytest.mark.parametrize("metric, p", [("euclidean", 2.0), ("manhattan", 1.0), ("minkowski", 3.0), ("minkowski", 2.5), ("hamming", 2.0)])
def test_nearest_over_blocks_is_exact(metric, p):
    """Train blocks one after the other, with ties, a block of one fold alone and fewer rows than ``k``."""
    rng = np.random.default_rng(4)
    train, test = rng.normal(size=(700, 6)), rng.normal(size=(600, 6))
    train[300:340], test[:20], test[20:30] = train[:40], train[20:40], 1e-9 * test[20:30]
    folds, mine, ids = rng.integers(0, 3, 700), rng.integers(0, 3, 600), rng.permutation(700)
    folds[:2] = 1
    best = neighbours._Best(pa.nulls(600, pa.int64()), 4)
    for low, high in ((0, 2), (2, 250), (250, 690), (690, 700)):
        best.meet(test, train[low:high], mine, folds[low:high], ids[low:high], low, metric, p)
    whole = neighbours._distances(test, train, metric, p)
    want = [(i, j) for i in range(600) for j in sorted(np.flatnonzero(folds != mine[i]), key=lambda j: (whole[i, j], ids[j]))[:4]]
    assert list(zip(best.row, best.place)) == want and np.allclose(best.distance, [whole[x] for x in want], rtol=1e-14, atol=0)


def test_blocks_are_not_copied_for_each_other(spark):
    rows = spark.createDataFrame([(i, 0, float(i * i)) for i in range(40)], "doc_id long, feature_id int, value double")
    l = labels(spark, ["a"] * 40)
    got = neighbours.nearest(rows, l, rows, l.select("doc_id"), 1, 2, train_block=4, test_block=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    # Each row's nearest of all ten train blocks, not of each.
    assert got.count() == 80 and got.filter("place = 1 AND neighbour <> doc_id").count() == 0

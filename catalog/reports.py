"""Queries: folds, reports, stacking and evolutionary search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FOLDS, LANG, PREDICTED, QUALITY, SOURCE, bayes, cells, coo, docs, folded_bayes, folds, lang, quality, query, r6, rates, shared, six, source, table, unit, whole, words
from catalog.models import _random_sql
from catalog.vectors import length
from sorrel.operators import evolve, folds as cv, report, stacking, weights
from sorrel.operators.baseline import random_baseline
from sorrel.operators.instances import label_list, predictions
from sorrel.plans import pipeline
from sorrel.plans.settings import Evolution, Features, Folds, Settings, Text, Vectors
from sorrel.plans.staging import assign_position, stage

RATES = ["pr", "re", "f1", "tpr", "fpr", "auc"]

# ----------------------------------------------------------------------------- folds


@query("assign_position", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::BIGINT AS pos FROM orders")
def assign_position_(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return assign_position(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).select("o_orderkey", "pos")


@query("make_folds", f"WITH {FOLDS} SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS pos, fold FROM folds")
def make_folds(spark, sf):
    return folds(spark, sf)


@query(
    "make_folds_in_blocks",
    "WITH t AS (SELECT (conv_id * 4294967296 + turn)::BIGINT AS doc_id, (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS pos FROM conversations) "
    "SELECT doc_id, pos, CASE WHEN pos >= 20 AND pos < 400 THEN (((pos - 20) // 4) % 5)::INT ELSE -1 END AS fold FROM t",
)
def make_folds_in_blocks(spark, sf):
    ids = table(spark, sf, "conversations").select((F.col("conv_id") * (1 << 32) + F.col("turn")).alias("doc_id"))
    return cv.make_folds(ids, 5, 4, 20, 400)


@query("split_fold", f"WITH {FOLDS}, {SOURCE} SELECT doc_id, label, CASE WHEN fold = 3 THEN 'test' ELSE 'train' END AS part FROM lab JOIN folds USING (doc_id)")
def split_fold(spark, sf):
    train, test = cv.split_fold(source(spark, sf), folds(spark, sf), 3)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@shared
def fold_scores(spark, sf):
    return stage(six(cv.FoldedBayes(words(spark, sf), lang(spark, sf), folds(spark, sf)).scores(), "prob"), "fold_scores")


@shared
def source_scores(spark, sf):
    """Ten-fold scores over the twenty sources.  The sources repeat in the order
    of the ids, so blocks of seven neighbours spread each over all folds."""
    blocks = stage(cv.make_folds(docs(spark, sf), 10, 7), "folds")
    scores = cv.FoldedBayes(words(spark, sf), source(spark, sf), blocks).scores()
    return stage(six(scores, "prob"), "source_scores")


CV = f"WITH {coo()}, {LANG}, {FOLDS}, {folded_bayes()}"
BLOCKS = "folds AS (SELECT doc_id, (((row_number() OVER (ORDER BY doc_id) - 1) // 7) % 10)::INT AS fold FROM documents)"
CV20 = f"WITH {coo()}, {SOURCE}, {BLOCKS}, {folded_bayes()}"


@query("cross_validate", f"{CV} SELECT fold, doc_id, label, prob FROM p")
def cross_validate(spark, sf):
    return fold_scores(spark, sf)


@query("cross_validate_unpruned", f"WITH {coo()}, {LANG}, {FOLDS}, {folded_bayes(None, True)} SELECT fold, doc_id, label, prob FROM p")
def cross_validate_unpruned(spark, sf):
    found = cv.FoldedBayes(words(spark, sf), lang(spark, sf), folds(spark, sf), None, True)
    return six(found.scores(), "prob")


PAIRS = f"{PREDICTED}, pairs AS (SELECT doc_id, label AS target, prediction FROM pred JOIN lab USING (doc_id))"
PERFORMANCE = (
    f"SELECT label, {rates()}, tot, clf, tp AS cor FROM cells UNION ALL SELECT 'micro' AS label, {rates()}, n AS tot, n AS clf, tp AS cor FROM "
    "(SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, max(n) AS n FROM cells)"
)


@query("validate_naive_bayes", f"{CV}, {PAIRS}, {cells()} {PERFORMANCE}")
def validate_naive_bayes(spark, sf):
    pairs = report.outcomes(predictions(fold_scores(spark, sf)), lang(spark, sf))
    return six(report.performance(pairs), *RATES)


# --------------------------------------------------------------------------- reports


def guesses(spark, sf):
    """Label-share draws against the true source: every cell is filled."""
    return report.outcomes(random_baseline(docs(spark, sf), source(spark, sf), "weighted"), source(spark, sf))


GUESS = _random_sql(SOURCE, True)
GUESSED = f"WITH pred AS ({GUESS}), {SOURCE}, pairs AS (SELECT doc_id, label AS target, prediction FROM pred JOIN lab USING (doc_id))"


@query("confusion_matrix", f"{GUESSED} SELECT target, prediction, count(*) AS n FROM pairs GROUP BY ALL")
def confusion_matrix(spark, sf):
    return report.confusion_matrix(guesses(spark, sf))


LANGS = ["de", "en", "es", "fr"]


@query(
    "confusion_pivot",
    f"WITH pred AS ({_random_sql(LANG, True)}), {LANG}, pairs AS (SELECT doc_id, label AS target, prediction FROM pred JOIN lab USING (doc_id)) SELECT target, "
    + ", ".join(f"count(*) FILTER (prediction = '{v}') AS {v}" for v in LANGS)
    + " FROM pairs GROUP BY target",
)
def confusion_pivot(spark, sf):
    pairs = report.outcomes(random_baseline(docs(spark, sf), lang(spark, sf), "weighted"), lang(spark, sf))
    return report.confusion_pivot(pairs, label_list(lang(spark, sf)))


@query("label_performance", f"{GUESSED}, {cells()} SELECT label, {rates()}, tot, clf, tp AS cor FROM cells UNION ALL SELECT 'unseen', 0, 0, 0, 0, 0, 0, 0, 0, 0")
def label_performance(spark, sf):
    known = source(spark, sf).select("label").union(spark.createDataFrame([("unseen",)], "label string"))
    return six(report.label_performance(guesses(spark, sf), known), *RATES)


@query("micro_performance", f"{GUESSED}, {cells()} SELECT * FROM ({PERFORMANCE}) WHERE label = 'micro'")
def micro_performance(spark, sf):
    return six(report.micro_performance(guesses(spark, sf)), *RATES)


# Order priorities as numbers against a hashed guess.
ORDINAL = (
    "WITH pairs AS (SELECT o_orderkey AS doc_id, o_orderpriority[1]::INT AS target, "
    f"(1 + floor({unit(42, 'o_orderkey')} * 5))::INT AS prediction FROM orders), {cells()}, "
    "err AS (SELECT target, avg(abs(target - prediction)::DOUBLE) AS mae, sqrt(avg(((target - prediction) * (target - prediction))::DOUBLE)) AS rmse FROM pairs GROUP BY ROLLUP (target)) "
    f"SELECT label::VARCHAR AS label, {rates()}, {r6('mae')} AS mae, {r6('rmse')} AS rmse, {r6('(tp + tn) / n::DOUBLE')} AS acc, tot, clf, tp AS cor FROM cells JOIN err ON target = label "
    f"UNION ALL SELECT 'overall', {rates()}, {r6('mae')}, {r6('rmse')}, {r6('tp / n::DOUBLE')}, n, n, tp FROM "
    "(SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, max(n) AS n FROM cells), err WHERE target IS NULL"
)


@query("ordinal_performance", ORDINAL)
def ordinal_performance(spark, sf):
    from sorrel.functions.hashing import hash_unit

    guess = (1 + F.floor(hash_unit(42, F.col("o_orderkey")) * 5)).cast("int")
    pairs = table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("target"), guess.alias("prediction"))
    return six(report.ordinal_performance(pairs), *RATES, "mae", "rmse", "acc")


def _at_k_sql(k: int) -> str:
    return (
        f"{CV20}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label) AS r FROM p), "
        f"pairs AS (SELECT l.doc_id, l.label AS target, CASE WHEN max((x.label = l.label)::INT) = 1 THEN l.label ELSE max(CASE WHEN x.r = 1 THEN x.label END) END AS prediction "
        f"FROM ranked x JOIN lab l USING (doc_id) WHERE x.r <= {k} GROUP BY l.doc_id, l.label), {cells()} {PERFORMANCE}"
    )


for _k in (3, 5, 7, 9):

    @query(f"performance_at_{_k}", _at_k_sql(_k))
    def performance_at_k(spark, sf, k=_k):
        return six(report.performance_at_k(source_scores(spark, sf), source(spark, sf), k), *RATES)


@query(
    "doc_predictions",
    f"{CV}, {PREDICTED} SELECT doc_id, l.label AS target, prediction, "
    + ", ".join(f"max(CASE WHEN p.label = '{v}' THEN prob END) AS prob_{v}" for v in LANGS)
    + " FROM p JOIN pred USING (doc_id) JOIN lab l USING (doc_id) GROUP BY ALL",
)
def doc_predictions(spark, sf):
    scores = fold_scores(spark, sf).drop("fold")
    return report.doc_predictions(scores, lang(spark, sf), label_list(lang(spark, sf)))


OUTCOMES = (
    f"{CV}, {PREDICTED}, o AS (SELECT p.label, p.doc_id, l.label AS target, prediction, prob, CASE WHEN prediction = p.label AND l.label = p.label THEN 'tp' "
    "WHEN prediction = p.label THEN 'fp' WHEN l.label = p.label THEN 'fn' ELSE 'tn' END AS outcome FROM p JOIN pred USING (doc_id) JOIN lab l USING (doc_id)), "
    "r AS (SELECT label, outcome, row_number() OVER (PARTITION BY label, outcome ORDER BY prob DESC, doc_id) AS rank, doc_id, target, prediction, prob FROM o)"
)


@query("ranked_outcomes", f"{OUTCOMES} SELECT * FROM r")
def ranked_outcomes(spark, sf):
    return whole(report.ranked_outcomes(fold_scores(spark, sf).drop("fold"), lang(spark, sf)), "rank")


for _kind in ("tp", "fp", "fn", "tn"):

    @query(f"ranked_{_kind}", f"{OUTCOMES} SELECT * FROM r WHERE label = 'en' AND outcome = '{_kind}'")
    def ranked(spark, sf, kind=_kind):
        return whole(report.ranked_outcomes(fold_scores(spark, sf).drop("fold"), lang(spark, sf), "en", kind), "rank")


def per_fold_sql(shown=r6) -> str:
    return (
        f"{CV}, {PREDICTED}, pairs AS (SELECT o.fold, doc_id, label AS target, prediction FROM pred JOIN lab USING (doc_id) JOIN folds o USING (doc_id)), {cells(by='fold')}, "
        f"perf AS (SELECT fold, label, {rates(shown)}, tot, clf, tp AS cor FROM cells UNION ALL SELECT fold, 'micro', {rates(shown)}, n, n, tp FROM "
        "(SELECT fold, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, max(n) AS n FROM cells GROUP BY fold))"
    )


def _per_fold(spark, sf):
    pairs = report.outcomes(predictions(fold_scores(spark, sf)), lang(spark, sf))
    return report.performance(pairs, by=["fold"])


@query("fold_performance", f"{per_fold_sql()} SELECT * FROM perf")
def fold_performance(spark, sf):
    return six(_per_fold(spark, sf), *RATES)


@query(
    "fold_summary",
    f"{per_fold_sql('({})'.format)} SELECT label, " + ", ".join(f"{r6(f'avg({c})')} AS {c}_mean, {r6(f'stddev_pop({c})')} AS {c}_std" for c in RATES)
    + ", sum(tot)::BIGINT AS tot, sum(clf)::BIGINT AS clf, sum(cor)::BIGINT AS cor FROM perf GROUP BY label",
)
def fold_summary(spark, sf):
    """The rates of a fold enter the means unrounded; the means are rounded once."""
    found = report.fold_summary(_per_fold(spark, sf))
    return six(found, *[f"{c}_{m}" for c in RATES for m in ("mean", "std")])


@query(
    "merge_fold_scores",
    f"{CV}, names AS (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS label) SELECT d.doc_id, l.label, coalesce(prob, 0.0) AS prob "
    "FROM folds d CROSS JOIN names l LEFT JOIN p ON p.doc_id = d.doc_id AND p.label = l.label",
)
def merge_fold_scores(spark, sf):
    scores = fold_scores(spark, sf)
    parts = [scores.filter(F.col("fold") == f) for f in range(10)]
    return report.merge_fold_scores(parts, [*LANGS, "xx"])


# -------------------------------------------------------------- appending and stacking


@query(
    "prediction_feature",
    f"{CV20}, {PREDICTED}, c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM lab)) "
    "SELECT doc_id, 'prediction' AS ftype, 'naive_bayes' AS feature, code::DOUBLE AS value FROM pred JOIN c ON c.label = prediction",
)
def prediction_feature(spark, sf):
    order = label_list(source(spark, sf))
    return stacking.prediction_feature(predictions(source_scores(spark, sf).drop("fold")), order, "naive_bayes")


@query("probability_features", f"{CV} SELECT doc_id, 'probability' AS ftype, label || '_prediction_prob' AS feature, prob AS value FROM p WHERE label IN ('en', 'fr')")
def probability_features(spark, sf):
    return stacking.probability_features(fold_scores(spark, sf), ["en", "fr"])


PLAIN = Settings(vectors=Vectors(prune=5000))
OOF = (
    f"WITH {coo()}, lab AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels WHERE quality IS NOT NULL), "
    "folds AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 5)::INT AS fold FROM lab), "
)


@shared
def oof(spark, sf):
    """Out-of-fold labels of the labelled documents, full-fit labels of the rest."""
    labels = quality(spark, sf).select("doc_id", "label")
    rest = docs(spark, sf).join(labels, "doc_id", "left_anti").select("doc_id")
    return stacking.out_of_fold_features(pipeline.trainer(PLAIN), words(spark, sf), labels, words(spark, sf), rest, "naive_bayes")


@query("out_of_fold_features", f"{OOF}{folded_bayes()}, {PREDICTED} SELECT doc_id, 'prediction' AS ftype, 'naive_bayes' AS feature, prediction::DOUBLE AS value FROM pred")
def out_of_fold_features(spark, sf):
    return oof(spark, sf)[0]


@query(
    "full_fit_features",
    f"WITH {coo()}, {QUALITY}, {bayes()}, {PREDICTED} SELECT doc_id, 'prediction' AS ftype, 'naive_bayes' AS feature, prediction::DOUBLE AS value FROM pred WHERE doc_id NOT IN (SELECT doc_id FROM lab)",
)
def full_fit_features(spark, sf):
    return oof(spark, sf)[1]


def _sizes(spark, sf):
    """Length bands of the documents as external features."""
    band = F.floor(F.log10(F.col("label_num") + 1)).cast("double")
    return length(spark, sf).select("doc_id", F.lit("csv").alias("ftype"), F.lit("length").alias("feature"), band.alias("value")).filter("value <> 0")


def _split(spark, sf):
    labels = quality(spark, sf).select("doc_id", "label")
    return labels, docs(spark, sf).join(labels, "doc_id", "left_anti").select("doc_id")


SIZES = (
    "sizes AS (SELECT doc_id, 'csv' AS ftype, 'csv:length' AS feature, floor(log10(n_chars + 1))::DOUBLE AS value FROM documents "
    "WHERE floor(log10(n_chars + 1)) <> 0)"
)
LABELLED = "lab AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels WHERE quality IS NOT NULL)"


def label_folds(n: int) -> str:
    return f"folds AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % {n})::INT AS fold FROM lab)"


@query(
    "classify_append",
    f"WITH {coo(name='wrd')}, {SIZES}, {LABELLED}, {label_folds(3)}, "
    f"held AS (WITH coo AS (SELECT * FROM wrd), {folded_bayes()}, {PREDICTED} SELECT doc_id, prediction FROM pred), "
    f"fresh AS (WITH coo AS (SELECT * FROM wrd), {bayes()}, {PREDICTED} SELECT doc_id, prediction FROM pred WHERE doc_id NOT IN (SELECT doc_id FROM lab)), "
    "guess AS (SELECT * FROM held UNION ALL SELECT * FROM fresh), "
    "coo AS (SELECT doc_id, 'prediction' AS ftype, 'BOW' AS feature, prediction::DOUBLE AS value FROM guess WHERE prediction <> '0' UNION ALL SELECT * FROM sizes), "
    f"{bayes()} SELECT doc_id, label, prob FROM p WHERE doc_id NOT IN (SELECT doc_id FROM lab)",
)
def classify_append(spark, sf):
    labels, rest = _split(spark, sf)
    found = stacking.classify_append(pipeline.trainer(PLAIN), words(spark, sf), labels, words(spark, sf), rest, _sizes(spark, sf), text=pipeline.trainer(PLAIN), n=3)
    return six(found, "prob")


BASE = ("naive_bayes", "tree")
STACK = Settings(vectors=Vectors(prune=200), ensemble=BASE, options={"tree": {"max_depth": 3}}, folds=Folds(n=2))


@query("stack_ensemble")
def stack_ensemble(spark, sf):
    labels, rest = _split(spark, sf)
    base = {name: pipeline.trainer(STACK, name) for name in BASE}
    return six(stacking.stack_ensemble(base, pipeline.trainer(STACK), words(spark, sf), labels, words(spark, sf), rest, n=2), "prob")


def _two(spark, sf, labels):
    return stage(cv.make_folds(labels, 2), "two")


@query(
    "validate_append",
    f"WITH {coo(name='wrd')}, {SIZES}, {LABELLED}, {label_folds(2)}, coo AS (SELECT * FROM wrd UNION ALL SELECT * FROM sizes), {folded_bayes()} "
    "SELECT fold, doc_id, label, prob FROM p",
)
def validate_append(spark, sf):
    labels, _ = _split(spark, sf)
    return six(stacking.validate_append(pipeline.trainer(PLAIN), words(spark, sf), labels, _two(spark, sf, labels), _sizes(spark, sf)), "prob")


@query("validate_ensemble")
def validate_ensemble(spark, sf):
    labels, _ = _split(spark, sf)
    base = {name: pipeline.trainer(STACK, name) for name in BASE}
    return six(stacking.validate_ensemble(base, pipeline.trainer(STACK), words(spark, sf), labels, _two(spark, sf, labels), n=2), "prob")


@query("run_validation", f"{CV}, {PAIRS}, {cells()} {PERFORMANCE}")
def run_validation(spark, sf):
    """Whole run in folds: text in, performance out."""
    settings = Settings(text=Text(False, True), features=Features(ngrams=(1,)))
    out = pipeline.run_pipeline(docs(spark, sf), lang(spark, sf), settings=settings)
    return six(out["performance"], *RATES)


@query("run_train_test", f"WITH {coo()}, {QUALITY}, {bayes()}, {PREDICTED} SELECT doc_id, prediction FROM pred")
def run_train_test(spark, sf):
    """Whole run on labelled documents, predictions for every document."""
    settings = Settings(text=Text(False, True), features=Features(ngrams=(1,)))
    return pipeline.run_pipeline(docs(spark, sf), quality(spark, sf), docs(spark, sf), settings=settings)["predictions"]


@query(
    "run_scaled",
    f"WITH {coo(name='wrd')}, {QUALITY}, mine AS (SELECT w.* FROM wrd w JOIN lab USING (doc_id)), "
    "top AS (SELECT feature FROM mine GROUP BY feature ORDER BY sum(value) DESC, feature LIMIT 5000), "
    "span AS (SELECT feature, CASE WHEN count(*) < (SELECT count(*) FROM lab) THEN 0.0 ELSE min(value) END AS lo, max(value) AS hi FROM mine JOIN top USING (feature) GROUP BY feature), "
    "coo AS (SELECT doc_id, ftype, feature, (value - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END AS value FROM wrd JOIN span USING (feature) WHERE value <> lo), "
    f"{bayes(vocab='SELECT feature FROM top')}, {PREDICTED} SELECT doc_id, prediction FROM pred",
)
def run_scaled(spark, sf):
    """Whole run: prune by counts, then scale the vectors, then classify."""
    settings = Settings(text=Text(False, True), features=Features(ngrams=(1,)), vectors=Vectors(scale=True))
    return pipeline.run_pipeline(docs(spark, sf), quality(spark, sf), docs(spark, sf), settings=settings)["predictions"]


@query(
    "run_append",
    f"WITH {coo(name='wrd')}, {SIZES}, {QUALITY}, coo AS (SELECT * FROM wrd UNION ALL SELECT * FROM sizes), {bayes()}, {PREDICTED} SELECT doc_id, prediction FROM pred",
)
def run_append(spark, sf):
    """Whole run on words and a length band of every document."""
    settings = Settings(text=Text(False, True), features=Features(ngrams=(1,)))
    return pipeline.run_pipeline(docs(spark, sf), quality(spark, sf), docs(spark, sf), append=_sizes(spark, sf), settings=settings)["predictions"]


@query(
    "run_evolved_validation",
    f"WITH {QUALITY} SELECT label, count(*) AS tot FROM lab GROUP BY label UNION ALL SELECT 'micro', count(*) FROM lab",
)
def run_evolved_validation(spark, sf):
    """Whole run in two folds, each with a search on its own train part: every document is scored once."""
    settings = Settings(
        text=Text(False, True), features=Features(ngrams=(1,)), folds=Folds(n=2), vectors=Vectors(prune=50),
        evolution=Evolution(ga=True, num_iterations=1, population_size=6),
    )
    return pipeline.run_pipeline(docs(spark, sf), quality(spark, sf), settings=settings)["performance"].select("label", "tot")


@query("train_full_model", f"WITH {coo()}, {LANG}, {bayes()} SELECT 'tokens' AS ftype, feature, label, {r6('w')} AS log_prob FROM w")
def train_full_model(spark, sf):
    from sorrel.operators import naive_bayes as nb

    _, model = pipeline.train_full_model(words(spark, sf), lang(spark, sf), PLAIN)
    return six(nb.feature_log_prob(model), "log_prob")


# ------------------------------------------------------------------ evolutionary search

POP = f"pop AS (SELECT cand_id, feature_id FROM (SELECT unnest(range(20)) AS cand_id) CROSS JOIN (SELECT unnest(range(100)) AS feature_id) WHERE {unit(42, 'cand_id', 'feature_id')} < 0.5)"


@shared
def evolving(spark, sf):
    """100 most frequent words, a sample by language and a first population."""
    chosen = stage(weights.prune_top_k(words(spark, sf), 100), "top")
    rows = stage(weights.select_features(words(spark, sf), chosen), "rows")
    sample = evolve.train_test_sample(lang(spark, sf), 0.8)
    population = stage(evolve.random_population(spark, 100, 20), "population")
    params = stage(evolve.random_parameters(spark, [0.5, 1.0], 20), "params")
    return rows, sample, population, params


@shared
def scored(spark, sf):
    rows, sample, population, params = evolving(spark, sf)
    found = evolve.score_candidates(evolve.prepare(rows, sample, 100), population, params)
    return stage(evolve.weighted_fitness(six(found, "fitness"), 100, "f1_micro", 0.1), "scored")


SAMPLE = (
    f"{LANG}, b AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS block FROM lab), "
    f"ordered AS (SELECT doc_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {unit(42, 'block')}, block) AS rank FROM b), "
    "sample AS (SELECT doc_id, label, rank <= least(floor(0.8 * n), n - 1) AS train FROM ordered)"
)


@query("random_population", f"WITH {POP} SELECT cand_id, feature_id::INT AS feature_id FROM pop")
def random_population(spark, sf):
    return evolving(spark, sf)[2]


@query("train_test_sample", f"WITH {SAMPLE} SELECT * FROM sample")
def train_test_sample(spark, sf):
    return evolving(spark, sf)[1]


SCORED = f"""
WITH {coo()}, {SAMPLE}, {POP}, top AS (SELECT feature, row_number() OVER (ORDER BY sum(value) DESC, feature) - 1 AS feature_id FROM coo GROUP BY feature ORDER BY sum(value) DESC, feature LIMIT 100),
par AS (SELECT cand_id, CASE WHEN {unit('42_p', 'cand_id')} < 0.5 THEN 0.5 ELSE 1.0 END AS a FROM (SELECT unnest(range(20)) AS cand_id)),
x AS (SELECT c.doc_id, feature_id, value, s.label, s.train FROM coo c JOIN top USING (feature) JOIN sample s USING (doc_id)),
cnt AS (SELECT label, feature_id, sum(value) AS n FROM x WHERE train GROUP BY ALL),
lv AS (SELECT f.feature_id, l.label, coalesce(n, 0) AS n FROM top f CROSS JOIN (SELECT DISTINCT label FROM lab) l LEFT JOIN cnt USING (feature_id, label)),
tot AS (SELECT cand_id, label, sum(n) AS t, count(*) AS v FROM pop JOIN lv USING (feature_id) GROUP BY ALL),
sc AS (SELECT cand_id, x.doc_id, lv.label, sum(x.value * (ln(lv.n + a) - ln(t + a * v))) AS s FROM x JOIN pop USING (feature_id) JOIN par USING (cand_id)
  JOIN lv USING (feature_id) JOIN tot ON tot.cand_id = pop.cand_id AND tot.label = lv.label WHERE NOT train GROUP BY ALL),
every AS (SELECT par.cand_id, sample.doc_id, l.label, round(coalesce(s, 0), 9) AS s FROM sample CROSS JOIN par CROSS JOIN (SELECT DISTINCT label FROM lab) l
  LEFT JOIN sc ON sc.cand_id = par.cand_id AND sc.doc_id = sample.doc_id AND sc.label = l.label WHERE NOT train),
best AS (SELECT cand_id, doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY cand_id, doc_id ORDER BY s DESC, label) AS r FROM every) WHERE r = 1),
fit AS (SELECT cand_id, {r6('avg((best.label = sample.label)::INT)')} AS fitness FROM best JOIN sample USING (doc_id) GROUP BY cand_id),
res AS (SELECT cand_id, fitness, (SELECT count(*) FROM pop WHERE pop.cand_id = fit.cand_id) AS n_features FROM fit),
wt AS (SELECT *, {r6('0.9 * fitness - 0.1 * n_features / 100.0::DOUBLE')} AS weighted FROM res)
"""


@query("score_candidates", f"{SCORED} SELECT cand_id, fitness, n_features FROM res")
def score_candidates(spark, sf):
    """The pooled F1 of single labels is the share of right documents."""
    return scored(spark, sf).drop("weighted")


@query("weighted_fitness", f"{SCORED} SELECT * FROM wt")
def weighted_fitness(spark, sf):
    return scored(spark, sf)


PLACE = "place AS (SELECT cand_id, row_number() OVER (ORDER BY -weighted, cand_id) - 1 AS place FROM wt)"
PARENTS = (
    f"{SCORED}, {PLACE}, draws AS (SELECT pair, side, min(2 + floor({unit('42_t', 'pair', 'side', 'draw')} * 18)::BIGINT) AS place "
    "FROM (SELECT unnest(range(9)) AS pair) CROSS JOIN (SELECT unnest([0, 1]) AS side) CROSS JOIN (SELECT unnest(range(2)) AS draw) GROUP BY ALL), "
    "parents AS (SELECT pair, side, cand_id FROM draws JOIN place USING (place))"
)
CHILDREN = (
    f"{PARENTS}, bits AS (SELECT pair, side, twin, pair * 2 + twin AS child, feature_id FROM parents JOIN pop USING (cand_id) CROSS JOIN (SELECT unnest([0, 1]) AS twin)), "
    f"children AS (SELECT child, feature_id FROM bits WHERE CASE WHEN {unit('42_x', 'pair')} < 0.9 THEN "
    f"(feature_id >= floor({unit('42_c0', 'child')} * 100))::INT % 2 = side ELSE twin = side END)"
)


@query("select_parents", f"{PARENTS} SELECT pair, side::INT AS side, cand_id FROM parents")
def select_parents(spark, sf):
    return evolve.select_parents(scored(spark, sf), "f1_micro", 9, 2)


@query("crossover", f"{CHILDREN} SELECT child, feature_id::INT AS feature_id FROM children")
def crossover(spark, sf):
    parents = evolve.select_parents(scored(spark, sf), "f1_micro", 9, 2)
    return evolve.crossover(evolving(spark, sf)[2], parents, 100)


@query(
    "mutate",
    f"{CHILDREN}, ids AS (SELECT unnest(range(18)) AS child), "
    f"flips AS (SELECT child, feature_id FROM ids CROSS JOIN (SELECT unnest(range(100)) AS feature_id) "
    f"WHERE {unit('42_x', 'child // 2')} < 0.9 AND {unit('42_m0', 'child', 'feature_id')} < 0.3), "
    "u AS (SELECT * FROM children UNION ALL SELECT * FROM flips), m AS (SELECT child, feature_id FROM u GROUP BY ALL HAVING count(*) = 1) "
    "SELECT child, feature_id::INT AS feature_id FROM m UNION ALL "
    f"SELECT child, floor({unit('42_m1', 'child')} * 100)::INT FROM ids WHERE child NOT IN (SELECT child FROM m)",
)
def mutate(spark, sf):
    parents = evolve.select_parents(scored(spark, sf), "f1_micro", 9, 2)
    children = evolve.crossover(evolving(spark, sf)[2], parents, 100)
    return evolve.mutate(children, 18, 100)


@shared
def evolved(spark, sf):
    return evolve.evolve(evolving(spark, sf)[0], lang(spark, sf), 100, num_iterations=2, population_size=10, alphas=(0.5, 1.0), weight_feature_size=0.1)


@query("evolve")
def evolve_(spark, sf):
    return evolved(spark, sf).best_features


@query("evolution_report")
def evolution_report(spark, sf):
    return evolve.evolution_report(evolved(spark, sf).rounds)


@query(
    "evolution_report_of_rounds",
    "SELECT l_linenumber AS round, " + ", ".join(
        f"{r6(f'avg({c})')} AS {n}_avg, {r6(f'median({c})')} AS {n}_median, {r6(f'max({c})')} AS {n}_best, {r6(f'min({c})')} AS {n}_worst"
        for n, c in (("fitness", "l_discount"), ("n_features", "l_quantity"), ("weighted", "l_tax"))
    ) + " FROM lineitem GROUP BY l_linenumber",
)
def evolution_report_of_rounds(spark, sf):
    """The report over a table of rounds with many candidates."""
    rounds = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("round"), F.col("l_discount").alias("fitness"), F.col("l_quantity").alias("n_features"), F.col("l_tax").alias("weighted")
    )
    names = [f"{n}_{m}" for n in ("fitness", "n_features", "weighted") for m in ("avg", "median", "best", "worst")]
    return six(evolve.evolution_report(rounds), *names)

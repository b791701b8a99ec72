"""Whole runs: documents and labels in, predictions and reports out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from sorrel.operators import evolve, folds as fold_ops, learners, naive_bayes as nb, neighbours, ngrams, ordinal, perceptron
from sorrel.operators import preprocess, report, stacking, weights
from sorrel.operators.baseline import random_baseline
from sorrel.operators.instances import label_list, predictions
from sorrel.operators.scaling import apply_minmax, fit_minmax
from sorrel.plans import search
from sorrel.plans.settings import Settings
from sorrel.plans.staging import assign_position, small_side, stage


def featurize(docs: DataFrame, settings: Settings) -> DataFrame:
    """``docs(doc_id, text)`` to the feature table of all chosen types."""
    text, chosen = settings.text, settings.features
    parts = []
    common = dict(n_list=chosen.ngrams, min_count=chosen.minimum_token_frequency, exclude=list(chosen.blackfeats) or None)
    if {"lemmas", "pos"} & set(chosen.featuretypes):
        if text.lexicon is None:
            raise ValueError("lemmas and pos need a lexicon")
        tokenised = stage(
            preprocess.annotate(preprocess.tokenize(docs, text.strip_punctuation), text.lexicon), "annotated"
        )
        if text.lowercase:
            tokenised = preprocess.lowercase(tokenised)
    else:
        tokenised = preprocess.sentence_tokens(docs, text.strip_punctuation, text.lowercase)
    for ftype in chosen.featuretypes:
        if ftype == "tokens":
            parts.append(ngrams.token_ngrams(tokenised, **common))
        elif ftype == "lemmas":
            parts.append(ngrams.lemma_ngrams(tokenised, **common))
        elif ftype == "pos":
            parts.append(ngrams.pos_ngrams(tokenised, **common))
        elif ftype == "chars":
            raw = docs.withColumn("text", F.lower("text")) if text.lowercase else docs
            parts.append(ngrams.char_ngrams(raw, **common))
        else:
            raise ValueError(f"unknown feature type: {ftype}")
    return stage(ngrams.combine_feature_types(*parts), "features")


# ----------------------------------------------------------------------- trainers

ML = {
    "svm": learners.kernel_svm,
    "logistic_regression": learners.logistic_regression,
    "xgboost": learners.boosted_trees,
    "tree": learners.decision_tree,
    "random_forest": learners.random_forest,
}
CLASSIFIERS = ["random", "naive_bayes", "knn", "perceptron", "linreg", *ML]


@dataclass
class Fitted:
    """All that the train documents fixed before a classifier is trained."""

    vectorizer: weights.Vectorizer
    scaler: DataFrame | None  # lower and upper bound of every selected feature
    columns: DataFrame | None  # (feature_id, new_id) that evolution kept
    options: dict  # of the classifier, with the search's parameters

    @property
    def size(self) -> int:
        return self.vectorizer.size if self.columns is None else self.columns.count()


def prepare(settings: Settings, name: str, features: DataFrame, labels: DataFrame) -> Fitted:
    """Vectorise, then scale, then evolve: on train documents only."""
    v, options = settings.vectors, dict(settings.options.get(name, {}))
    model = weights.fit_vectorizer(
        features, labels, v.weight, v.prune, v.select, v.select_threshold, v.balance, settings.seed
    )
    fitted = Fitted(model, None, None, options)
    if v.scale:
        fitted.scaler = stage(fit_minmax(model.train, model.train_labels.count()), "scaler")
        ids = [c for c in ("doc_id", "copy") if c in model.train_labels.columns]
        model.train = stage(apply_minmax(model.train, fitted.scaler, model.train_labels.select(*ids), v.min_scale, v.max_scale), "scaled")
    if settings.evolution.ga:
        fitted.columns, alpha = evolved_columns(model, settings)
        model.train = _kept(model.train, fitted.columns)
        if name == "naive_bayes":
            fitted.options["alpha"] = alpha
    if grid := search.grid_of(name, fitted.options):
        fitted.options |= searched(name, fitted, grid, settings)[0]
    return fitted


def searched(name: str, fitted: Fitted, grid: dict, settings: Settings) -> tuple[dict, list]:
    """The best of the searched parameters, and all that were tried with their scores."""
    base = fitted.vectorizer

    def fit_score(setting, rows, labels, test, docs):
        part = replace(base, train=rows, train_labels=labels)
        return score(name, replace(fitted, vectorizer=part, options={**fitted.options, **setting}), test, docs, settings)

    tried = search.settings_to_try(name, grid, settings.iterations, settings.seed)
    fixed = fitted.options
    if name == "logistic_regression" and fixed.get("multiclass", "ovr") == "ovr" and set(grid) <= {"c", "penalty"}:
        full = [{"c": fixed.get("c", 1.0), "penalty": fixed.get("penalty", "l2")} | setting for setting in tried]
        best, scored = search.search_logistic(
            base.train, base.train_labels, fitted.size, full, settings.scoring, fixed.get("max_iter", 1000), seed=settings.seed
        )
        shown = [{k: setting[k] for k in grid} for setting in full]
        return shown[full.index(best)], [(own, value) for own, (_, value) in zip(shown, scored)]
    return search.search(fit_score, base.train, base.train_labels, tried, settings.scoring, seed=settings.seed)


def transform(fitted: Fitted, features: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Any documents as the train documents' columns."""
    v = settings.vectors
    out = weights.apply_vectorizer(fitted.vectorizer, features)
    if fitted.scaler is not None:
        out = apply_minmax(out, fitted.scaler, docs, v.min_scale, v.max_scale)
    return out if fitted.columns is None else _kept(out, fitted.columns)


def _kept(rows: DataFrame, columns: DataFrame) -> DataFrame:
    joined = rows.join(small_side(columns), "feature_id")
    return joined.withColumn("feature_id", F.col("new_id")).select(*rows.columns)


def trainer(settings: Settings, classifier: str | None = None):
    """The fitted part of a run as one function for folds, append and stacks."""
    name = classifier or settings.classifier
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier: {name}")

    def train(features, labels, test_features, test_docs):
        if name == "random":
            mode = settings.options.get(name, {}).get("mode", "equal")
            drawn = random_baseline(test_docs, labels, mode, settings.seed)
            return drawn.select("doc_id", F.col("prediction").alias("label"), F.lit(1.0).alias("prob"))
        fitted = prepare(settings, name, features, labels)
        test = transform(fitted, test_features, test_docs.select("doc_id"), settings)
        return score(name, fitted, test, test_docs, settings)

    return train


def model_of(name: str, fitted: Fitted, settings: Settings):
    """The fitted classifier itself; k-NN and the random baseline have none."""
    train, labels = fitted.vectorizer.train, fitted.vectorizer.train_labels
    size, options = fitted.size, fitted.options
    if name == "naive_bayes":
        return nb.fit_naive_bayes(train, labels, vocab_size=size, **options)
    if name == "perceptron":
        return perceptron.fit_perceptron(train, labels, size, seed=settings.seed, **options)
    if name == "linreg":
        return learners.linear_regression(train, numeric_labels(labels), size, **options)
    return ML[name](train, labels, size, **options) if name in ML else None


def numeric_labels(labels: DataFrame) -> DataFrame:
    """``label_num`` of every row, from the label where it is not given; a label that is no number is an error."""
    given = F.col("label_num") if "label_num" in labels.columns else F.lit(None).cast("double")
    return labels.withColumn("label_num", F.coalesce(given, F.col("label").cast("string").cast("double")))


def score(name, fitted: Fitted, test, test_docs, settings) -> DataFrame:
    """Fit one classifier on the vectorised train set and score the test set."""
    train, labels = fitted.vectorizer.train, fitted.vectorizer.train_labels
    if name == "knn":
        if "copy" in labels.columns:
            raise ValueError("k-NN takes no balanced copies")
        return neighbours.knn(train, labels, test, test_docs.select("doc_id"), fitted.size, **fitted.options)
    model = model_of(name, fitted, settings)
    if name == "linreg":
        guessed = model.predict(test, test_docs)
        if settings.linear_raw:
            named = ordinal.translate_numeric(guessed, numeric_labels(labels))
        else:
            named = ordinal.nearest_ordinal(guessed).withColumn("prediction", F.col("prediction").cast("string"))
        return named.select("doc_id", F.col("prediction").alias("label"), F.lit(1.0).alias("prob"))
    return model.scores(test, test_docs)


def run_trainer(settings: Settings, external: DataFrame | None = None):
    """Plain, appended or stacked classification, as the settings ask."""
    final = trainer(settings)
    if settings.ensemble:
        return stacking.ensemble_trainer({name: trainer(settings, name) for name in settings.ensemble}, final)
    if external is not None:
        a = settings.append
        text = trainer(settings, a.bow_classifier) if a.bow_as_feature else None
        return stacking.append_trainer(final, external, text, a.bow_nfolds, a.bow_prediction_probs, a.bow_include_labels)
    return final


# --------------------------------------------------------------------------- runs


def reports(scores: DataFrame, labels: DataFrame, ordinal_labels: bool = False) -> dict[str, DataFrame]:
    """Every report table of one set of scored documents."""
    scores = stage(scores, "scores")
    order = label_list(labels)
    pairs = stage(report.outcomes(predictions(scores), labels), "outcomes")
    out = {
        "predictions": predictions(scores),
        "scores": scores,
        "performance": report.ordinal_performance(pairs) if ordinal_labels else report.performance(pairs, labels),
        "confusion_matrix": report.confusion_matrix(pairs),
        "docpredictions": report.doc_predictions(scores, labels, order),
        "ranked": report.ranked_outcomes(scores, labels),
    }
    for k in report.allowed_ks(len(order)):
        out[f"performance_at_{k}"] = report.performance_at_k(scores, labels, k)
    return out


def validate(features: DataFrame, labels: DataFrame, settings: Settings, external: DataFrame | None = None) -> DataFrame:
    """``(fold, doc_id, label, prob)`` over all folds.

    Naive Bayes on raw or binary counts runs all folds as one grouped job;
    anything else is fitted fold by fold.
    """
    f, v = settings.folds, settings.vectors
    folds = stage(fold_ops.make_folds(labels, f.n, f.steps, f.teststart, f.testend), "folds")
    plain = v.weight in ("frequency", "binary") and not (v.select or v.balance or v.scale or settings.evolution.ga or settings.ensemble or external is not None)
    options = settings.options.get("naive_bayes", {})
    if settings.classifier == "naive_bayes" and plain and not search.grid_of("naive_bayes", options):
        rows = weights.weight_binary(features) if v.weight == "binary" else features
        folded = fold_ops.FoldedBayes(rows, labels, folds, v.prune, options.get("fit_prior", False))
        return folded.scores(options.get("alpha", 1.0))
    return fold_ops.cross_validate(features, labels, folds, run_trainer(settings, external))


def train_full_model(features: DataFrame, labels: DataFrame, settings: Settings):
    """The fitted preparation and the model of all data; the model is None for learners that keep none."""
    fitted = prepare(settings, settings.classifier, features, labels)
    return fitted, model_of(settings.classifier, fitted, settings)


def run_pipeline(
    docs: DataFrame,
    labels: DataFrame,
    test_docs: DataFrame | None = None,
    test_labels: DataFrame | None = None,
    append: DataFrame | None = None,
    settings: Settings | None = None,
) -> dict[str, DataFrame]:
    """Train, test and report, or validate in folds where no test set is given.

    ``append`` holds external features of train and test documents.  With an
    ensemble or append the run is stacked or joined accordingly.  With
    ``settings.full_model`` the model of all labelled documents is returned beside
    the tables, as ``fitted`` and ``model``.
    """
    settings = settings or Settings()
    keep = ["doc_id", "label"] + (["label_num"] if "label_num" in labels.columns else [])
    labels = stage(labels.select(*keep), "labels")
    # Test ids may repeat train ids, so both sets are featurised apart.
    train = featurize(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), settings)
    if test_docs is None:
        scores = stage(validate(train, labels, settings, append), "cv")
        out = reports(scores.drop("fold"), labels, settings.ordinal)
        pairs = report.outcomes(predictions(scores), labels)
        per_fold = report.performance(pairs, by=["fold"])
        out["fold_performance"] = per_fold
        out["fold_summary"] = report.fold_summary(per_fold)
        if settings.full_model:
            out["fitted"], out["model"] = train_full_model(train, labels, settings)
        return out
    test = featurize(test_docs, settings)
    scores = stage(run_trainer(settings, append)(train, labels, test, test_docs.select("doc_id")), "scores")
    if test_labels is None:
        return {"scores": scores, "predictions": predictions(scores)}
    return reports(scores, test_labels, settings.ordinal)


def evolved_columns(model: weights.Vectorizer, settings: Settings) -> tuple[DataFrame, float]:
    """``(feature_id, new_id)`` of the fittest candidate (the first one on a tie), and its smoothing or ``c``.

    Logistic regression and the linear support vector machine score candidates by their own kind of model; all others by naive Bayes.
    """
    e, name = settings.evolution, settings.classifier
    options = settings.options.get(name, {})
    kind = name if name == "logistic_regression" or (name == "svm" and options.get("kernel", "linear") == "linear") else "naive_bayes"
    tuned = "alpha" if kind == "naive_bayes" else "c"
    alphas = settings.options.get(kind, {}).get(tuned, 1.0)
    if isinstance(alphas, str):
        alphas = search.VALUES[kind][tuned]
    rows, labels = model.train, model.train_labels
    if "copy" in labels.columns:
        # Balanced copies are documents of their own here.
        ids = assign_position(labels.select("doc_id", "copy", "label"), [F.col("doc_id").asc(), F.col("copy").asc()], "_id")
        rows = rows.join(ids.drop("label"), ["doc_id", "copy"]).select(F.col("_id").alias("doc_id"), "feature_id", "value")
        labels = ids.select(F.col("_id").alias("doc_id"), "label")
    found = evolve.evolve(
        rows, labels, model.size, e.metric, e.num_iterations, e.population_size, e.elite, e.crossover_probability,
        e.mutation_rate, e.tournament_size, e.n_crossovers, e.stop_condition, e.weight_feature_size,
        alphas if isinstance(alphas, (list, tuple)) else (alphas,), e.sampling, e.samplesize, settings.folds.steps, settings.seed,
        classifier=kind,
    )
    first = found.best_parameters.orderBy("cand_id").first()
    ids = found.best_features.filter(F.col("cand_id") == first["cand_id"]).select("feature_id")
    placed = assign_position(ids, [F.col("feature_id").asc()], "_new")
    return stage(placed.select("feature_id", F.col("_new").cast("int").alias("new_id")), "evolved"), first["alpha"]

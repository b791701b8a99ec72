"""Parameters of a whole run with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Text:
    strip_punctuation: bool = True
    lowercase: bool = False
    lexicon: object = None  # (text, lemma, pos), needed for lemmas and pos


@dataclass
class Features:
    featuretypes: tuple = ("tokens",)  # also lemmas, pos, chars
    ngrams: tuple = (1, 2, 3)
    blackfeats: tuple = ()
    minimum_token_frequency: int = 1


@dataclass
class Vectors:
    weight: str = "frequency"  # binary, tfidf, infogain
    prune: int | None = 5000
    balance: bool | str = False
    select: str | None = None  # fcbf, mrmr_linear
    select_threshold: object = None
    scale: bool = False
    min_scale: float = 0.0
    max_scale: float = 1.0


@dataclass
class Folds:
    n: int = 10
    steps: int = 1
    teststart: int = 0
    testend: int = -1


@dataclass
class Append:
    bow_as_feature: bool = False
    bow_classifier: str = "naive_bayes"
    bow_nfolds: int = 5
    bow_include_labels: list | None = None  # None is all
    bow_prediction_probs: bool = False


@dataclass
class Evolution:
    ga: bool = False
    num_iterations: int = 300
    elite: float = 0.1
    population_size: int = 100
    crossover_probability: float = 0.9
    mutation_rate: float = 0.3
    tournament_size: int = 2
    n_crossovers: int = 1
    stop_condition: int = 5
    weight_feature_size: float = 0.0
    sampling: bool = False
    samplesize: float = 0.8
    metric: str = "f1_micro"


@dataclass
class Settings:
    """``options`` holds the keyword arguments of a classifier by its name,
    such as ``{"naive_bayes": {"alpha": 1.0, "fit_prior": False}}``."""

    classifier: str = "naive_bayes"
    ensemble: tuple = ()
    ordinal: bool = False
    linear_raw: bool = False
    full_model: bool = False  # beside validation, the model of all documents
    iterations: int = 10
    scoring: str = "roc_auc"
    seed: int = 42
    options: dict = field(default_factory=dict)
    text: Text = field(default_factory=Text)
    features: Features = field(default_factory=Features)
    vectors: Vectors = field(default_factory=Vectors)
    folds: Folds = field(default_factory=Folds)
    append: Append = field(default_factory=Append)
    evolution: Evolution = field(default_factory=Evolution)

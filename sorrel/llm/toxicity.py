"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each model also
reads the probabilities of the categories before it.  In training those are
out-of-fold predictions, so a later model learns from probabilities as good as
the ones it will meet.  Folds follow the text, so copies share a fold.

Features of a text: presence of its words and of their first 3 to 6 letters
(inflected and invented forms share a stem), and a few shares such as symbols
and repeated words.  Words and stems enter a model if they differ clearly
between its classes.

The chain is fitted on a bounded sample: at most ``rows`` labelled texts, those of at
most ``row_chars`` characters first, then those with the smallest hashed key; a
longer text gives a part of ``row_chars`` characters at a hashed place.  Prediction
reads every whole text.  Null texts count as empty and get the probabilities of
a text without words.  Rows without a label, or with a null one, are not learned
from; of several labels of one key the larger counts.  Without any labelled
text of both classes a category's probability is its share, or 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sorrel.llm.batches import bounded, text_window

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[^\w\s]")

STEMS = (3, 4, 5, 6)
FOLDS = 5
# A word or stem enters a model if its shares differ by so many standard errors, the clearest ones first.
CLEAR, MOST = 5.0, 600
# Texts of the sample that a word or stem has to occur in.
SEEN = 3
# Words that a task keeps with their features.
WORDS = 300_000


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}-" for n in STEMS if len(word) >= n))


def shares(text: str, counts: Counter) -> list[float]:
    """Of a text and its counted words: length, variety, symbols, digits, word length, commonest word."""
    n, chars = max(1, counts.total()), max(1, len(text))
    return [
        np.log1p(counts.total()) / 10, len(counts) / n, len(_SYMBOL.findall(text)) / chars,
        sum(map(text.count, "0123456789")) / chars, sum(len(w) * c for w, c in counts.items()) / n / 10,
        max(counts.values(), default=0) / n,
    ]


def standard(dense: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard scores; texts unlike any that was learned from count as three deviations off."""
    return np.clip((dense - middle) / scale, -3, 3)


class Linear(NamedTuple):
    """Logistic model over chosen word features, shares and earlier probabilities."""

    chosen: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    scale: np.ndarray

    def probability(self, found: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """``found``: texts x chosen features; ``dense``: texts x the other inputs."""
        x = np.hstack((found, standard(dense, self.middle, self.scale), np.ones((len(dense), 1))))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


class Chain(NamedTuple):
    categories: tuple[str, ...]
    models: list[Linear]
    numbers: dict[str, int]
    limits: list[float]  # probability from which a text has the category


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, size: int, rounds: int = 200, ridge: float = 0.3) -> Linear:
    """Ridge logistic regression by accelerated gradient steps."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        share = n1 / len(y) if len(y) else 0.0
        weights = np.zeros(dense.shape[1] + 1)
        weights[-1] = np.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0)
        return Linear(np.zeros(0, np.int64), weights, np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
    count = [np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == c] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=size) for c in (0, 1)]
    p = (count[0] + count[1] + 1) / (len(y) + 2)
    z = np.abs(count[1] / n1 - count[0] / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    chosen = np.sort(np.argsort(-z, kind="stable")[: min(MOST, int((z >= CLEAR).sum()))])
    middle, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)
    x = np.hstack((presence(rows, chosen, size), standard(dense, middle, scale), np.ones((len(y), 1))))
    # The largest curvature, by power steps and with room to spare.
    top = np.ones(x.shape[1])
    for _ in range(20):
        top = x.T @ (x @ (top / np.linalg.norm(top)))
    step = 1 / (0.3 * np.linalg.norm(top) + ridge)
    w = look = np.zeros(x.shape[1])
    for k in range(rounds):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ look, -40, 40))) - y) + ridge * look
        new = look - step * slope
        look, w = new + k / (k + 3) * (new - w), new
    return Linear(chosen, w, middle, scale)


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts the classes best, halfway between its neighbours.

    Best is the F measure that counts precision twice as much as recall: a clean text lost weighs more.
    """
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    ranked, hits = p[order], np.cumsum(y[order])
    cut = np.append(ranked[:-1] > ranked[1:], True)  # equal probabilities stay together
    f = np.where(cut, 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum()), -1)
    k = int(f.argmax())
    return float((ranked[k] + (ranked[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def presence(rows: list[np.ndarray], chosen: np.ndarray, size: int) -> np.ndarray:
    """Texts x chosen features, 1 where a text has the feature; features are below ``size``."""
    column = np.full(size, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    out = np.zeros((len(rows), len(chosen)))
    for n, r in enumerate(rows):
        at = column[r]
        out[n, at[at >= 0]] = 1
    return out


def fit_chain(texts: list[str], labels: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """Chain of models; ``labels``: texts x categories of 0 and 1, in the chain's order."""
    words = [Counter(_WORD.findall(t.lower())) for t in texts]
    seen = [set().union(*map(features_of, w)) for w in words]
    often = Counter(f for s in seen for f in s)
    numbers = {f: n for n, f in enumerate(sorted(f for f, c in often.items() if c >= SEEN))}
    rows = [np.array(sorted(numbers[f] for f in s if f in numbers), np.int64) for s in seen]
    dense = np.array([shares(t, w) for t, w in zip(texts, words, strict=True)]).reshape(len(texts), 6)
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts], np.int64)
    models, limits = [], []
    for j in range(len(categories)):
        y = labels[:, j].astype(float)
        models.append(fit_linear(rows, dense, y, len(numbers)))
        outside = np.zeros(len(texts))
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(test):
                part = fit_linear([rows[i] for i in train], dense[train], y[train], len(numbers))
                outside[test] = part.probability(presence([rows[i] for i in test], part.chosen, len(numbers)), dense[test])
        limits.append(best_limit(outside, y))
        dense = np.column_stack((dense, outside))
    # Only features that some model reads are sent to the tasks.
    used = np.unique(np.concatenate([m.chosen for m in models] or [np.zeros(0, np.int64)])).astype(np.int64)
    names = {n: f for f, n in numbers.items()}
    models = [m._replace(chosen=np.searchsorted(used, m.chosen)) for m in models]
    return Chain(categories, models, {names[n]: k for k, n in enumerate(used.tolist())}, limits)


def predict(texts: list[str], chain: Chain, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Probabilities (texts x categories); ``known`` keeps the features of words met before."""
    rows, dense = [], np.zeros((len(texts), 6))
    for n, t in enumerate(texts):
        words = Counter(_WORD.findall(t.lower()))
        found: set[int] = set()
        for w in words:
            if (ids := known.get(w)) is None:
                if len(known) >= WORDS:
                    known.clear()
                ids = known[w] = tuple(chain.numbers[f] for f in features_of(w) if f in chain.numbers)
            found.update(ids)
        rows.append(np.array(sorted(found), np.int64))
        dense[n] = shares(t, words)
    out = np.zeros((len(texts), len(chain.categories)))
    for j, m in enumerate(chain.models):
        out[:, j] = m.probability(presence(rows, m.chosen, len(chain.numbers)), np.column_stack((dense, out[:, :j])))
    return out


def sample(
    docs: DataFrame, labels: DataFrame, columns: dict[str, Column], key: str, text: str, rows: int, row_chars: int
) -> tuple[list[str], np.ndarray]:
    """Texts and labels (in the order of ``columns``) of the bounded sample."""
    told = labels.select(F.col(key).alias("id"), *(c.cast("int").alias(f"y{n}") for n, c in enumerate(columns.values())))
    names = [f"y{n}" for n in range(len(columns))]
    told = told.dropna().groupBy("id").agg(*(F.max(c).alias(c) for c in names))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.length(text) > row_chars).alias("long"))
    texts = texts.filter(F.col("text").isNotNull())
    sizes = texts.groupBy("id").agg(F.min("long").alias("long"))
    chosen = told.join(sizes, "id").orderBy("long", F.xxhash64("id"), "id").limit(rows)
    found = texts.join(F.broadcast(chosen), ["id", "long"]).dropDuplicates(["id"])
    found = found.withColumn("text", text_window(F.col("text"), row_chars)).orderBy("id").collect()
    return [r["text"] for r in found], np.array([[r[c] for c in names] for r in found]).reshape(len(found), len(names))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    columns: dict[str, Column],
    key: str = "doc_id",
    text: str = "text",
    rows: int = 4000,
    row_chars: int = 8000,
) -> DataFrame:
    """``(key, p_<category>..., <category>...)``, one row per input row.

    ``columns`` gives, in the order of the chain, each category's 0/1 label as a
    column of ``labels``.  A text has a category from the probability on that
    parts the classes best out of fold.
    """
    bounded(docs.sparkSession)
    chain = fit_chain(*sample(docs, labels, columns, key, text, rows, row_chars), tuple(columns))
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in columns]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            yield pd.DataFrame(predict(batch.fillna("").tolist(), sent.value, known), columns=names, index=batch.index)

    scored = docs.select(F.col(key), score(F.col(text)).alias("_p"))
    has = [(F.col(f"_p.{n}") >= limit).alias(c) for n, c, limit in zip(names, columns, chain.limits, strict=True)]
    return scored.select(key, *(f"_p.{n}" for n in names), *has)

"""Folds and n-fold validation."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from sorrel.operators import naive_bayes as nb
from sorrel.operators.instances import in_order
from sorrel.operators.ngrams import KEY
from sorrel.operators.weights import prune_top_k
from sorrel.plans.staging import assign_position, fits, join_documents, skew_join, stage, stage_by_document


def make_folds(docs: DataFrame, n: int = 10, steps: int = 1, start: int = 0, end: int = -1) -> DataFrame:
    """``(doc_id, pos, fold)``: blocks of ``steps`` neighbours dealt round-robin.

    Documents outside ``[start, end)`` get fold -1 and serve for training only.
    """
    placed = assign_position(docs.select("doc_id"), [F.col("doc_id").asc()])
    inside = F.col("pos") >= start
    if end >= 0:
        inside &= F.col("pos") < end
    fold = F.floor((F.col("pos") - start) / steps) % n
    return placed.select("doc_id", "pos", F.when(inside, fold).otherwise(F.lit(-1)).cast("int").alias("fold"))


def split_fold(table: DataFrame, folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold."""
    joined = table.join(folds.select("doc_id", "fold"), "doc_id")
    pick = lambda cond: joined.filter(cond).drop("fold")
    return pick(F.col("fold") != fold), pick(F.col("fold") == fold)


# ------------------------------------------- naive Bayes: every fold in one job


class FoldedBayes:
    """Train counts of all folds at once: corpus counts minus the fold's own.

    The corpus is counted a single time by (fold, label, feature).  The model
    of a fold is needed only for features its test documents can hold.
    """

    def __init__(self, features, labels, folds, prune: int | None = 5000, fit_prior: bool = False):
        keyed = labels.select("doc_id", "label").join(folds.select("doc_id", "fold"), "doc_id")
        self.docs = stage(keyed, "folds")
        self.small = fits(self.docs)
        sizes = self.docs.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()
        self.folds = sorted({r["fold"] for r in sizes if r["fold"] >= 0})
        self.labels = in_order({r["label"] for r in sizes})
        k = len(self.labels)
        self.rows = features.select("doc_id", *KEY, "value")
        if not getattr(features, "_table", None):
            self.rows = stage_by_document(join_documents(self.rows, self.docs.select("doc_id"), "left_semi", self.small), "rows")
        # Labels as codes, which rows compare faster.
        code = (F.array_position(F.array(*[F.lit(v) for v in self.labels]), F.col("label")) - 1).cast("int")
        self.coded = self.docs.select("doc_id", "fold", code.alias("label"))
        if prune:
            own, corpus = self._pruned(prune)
            left = F.zip_with("all", F.coalesce("counts", nb._array([0.0] * k)), lambda a, c: a - c)
            tops = []
            for i, f in enumerate(self.folds):
                train = corpus.select(*KEY, "all", "df", (F.col("sum") - F.col("held")[i]).alias("total"))
                top = prune_top_k(train.filter("total > 0"), prune).drop("feature_id")
                tops.append(top.select(F.lit(f).alias("fold"), *KEY))
            kept = stage(reduce(DataFrame.unionByName, tops), "kept")
            # No more than folds x prune rows.
            tests = own.filter("fold >= 0").select("fold", *KEY, "df", "counts")
            train = kept.join(corpus.select(*KEY, "all"), KEY).join(tests, ["fold", *KEY], "left")
            model = stage(train.select("fold", *KEY, F.coalesce("df", F.lit(0)).alias("df"), left.alias("counts")), "model")
            sums = model.groupBy("fold").agg(F.count("*").alias("v"), *[F.sum(F.col("counts")[i]).alias(f"t{i}") for i in range(k)])
            tokens = {r["fold"]: ([r[f"t{i}"] for i in range(k)], r["v"]) for r in sums.collect()}
        else:
            own, corpus = self._counted(self.rows)
            tests = own.filter("fold >= 0").select("fold", *KEY, "df", "total", "counts")
            left = F.zip_with("all", "counts", lambda a, c: a - c)
            joined = tests.join(corpus.select(*KEY, "all", "sum"), KEY)
            known = F.col("sum") > F.col("total")
            model = stage(joined.filter(known).select("fold", *KEY, "df", left.alias("counts")), "model")
            top = corpus.agg(
                *[F.sum(F.col("all")[i]).alias(f"t{i}") for i in range(k)],
                *[F.sum((F.col("sum") > F.col("held")[j]).cast("long")).alias(f"v{j}") for j in range(len(self.folds))],
            ).first()
            held = tests.groupBy("fold").agg(*[F.sum(F.col("counts")[i]).alias(f"t{i}") for i in range(k)])
            held = {r["fold"]: [r[f"t{i}"] for i in range(k)] for r in held.collect()}
            tokens = {
                f: ([top[f"t{i}"] - held.get(f, [0.0] * k)[i] for i in range(k)], top[f"v{j}"])
                for j, f in enumerate(self.folds)
            }
        self.model = model
        counts = {(r["fold"], r["label"]): r["n"] for r in sizes}
        every = {v: sum(n for (_, w), n in counts.items() if w == v) for v in self.labels}
        out = []
        for f in self.folds:
            n = [every[v] - counts.get((f, v), 0) for v in self.labels]
            seen = sum(1 for c in n if c)
            prior = [-math.inf if c == 0 else (math.log(c / sum(n)) if fit_prior else -math.log(seen)) for c in n]
            sums, size = tokens.get(f, ([0.0] * k, 0))
            out.append((f, [float(t) for t in sums], float(size), prior))
        schema = "fold int, tokens array<double>, v double, prior array<double>"
        self.stats = features.sparkSession.createDataFrame(out, schema)

    def _counted(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Counts of features by label: of each fold's own documents, and of the corpus with the folds' shares."""
        k = len(self.labels)
        rows = join_documents(rows, self.coded, small=self.small)
        own = stage(nb.label_counts(rows, list(range(k)), ["fold", *KEY]), "own")
        sums = F.array(*[F.sum(F.col("counts")[i]) for i in range(k)])
        whole = F.col("total")
        held = F.array(*[F.sum(F.when(F.col("fold") == f, whole).otherwise(0.0)) for f in self.folds])
        corpus = own.groupBy(*KEY).agg(sums.alias("all"), F.sum("df").alias("df"), F.sum(whole).alias("sum"), held.alias("held"))
        return own, stage(corpus, "corpus")

    def _pruned(self, k: int) -> tuple[DataFrame, DataFrame]:
        """The counts of all features that can be among the ``k`` most frequent of some fold's train documents.

        Without negative values no feature is more frequent in a part than in the corpus, so the k-th place
        of a fold among some features bounds its last place from below, and rarer ones need no counts by label.
        """
        value = F.col("value")
        rows = join_documents(self.rows, self.coded.select("doc_id"), small=self.small)
        totals = rows.groupBy(*KEY).agg(F.sum(value).alias("total"), F.count("*").alias("df"), F.min(value).alias("least"))
        totals = stage(totals, "totals")
        first = totals.agg(F.count("*").alias("n"), F.min("least").alias("least")).first()
        if first["n"] <= 2 * k or first["least"] < 0 or not self.folds:
            return self._counted(self.rows)
        near = stage(totals.orderBy(F.col("total").desc()).limit(2 * k), "near")
        own, corpus = self._counted(skew_join(self.rows, near, KEY, how="left_semi"))
        parts = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("sum") - F.col("held")[i]).alias("t")) for i in range(len(self.folds))])
        place = F.row_number().over(Window.partitionBy("i").orderBy(F.col("t").desc()))
        train = corpus.select(F.explode(parts).alias("_p")).select("_p.*").withColumn("place", place)
        last = train.filter(F.col("place") == k).agg(F.min("t")).first()[0]
        # Sums of fractions may differ in their last digits.
        last -= 1e-9 * abs(last)
        if near.agg(F.min("total")).first()[0] < last:
            return own, corpus
        wider = stage(totals.filter(F.col("total") >= last), "near")
        return self._counted(skew_join(self.rows, wider, KEY, how="left_semi"))

    def _tests(self) -> DataFrame:
        """Feature rows of the test documents with their fold."""
        return join_documents(self.rows, self.docs.filter("fold >= 0").select("doc_id", "fold"), small=self.small)

    def _weights(self, alpha: float):
        dens = F.transform("tokens", lambda t: F.log(t + F.lit(alpha) * F.col("v")))
        return F.zip_with("counts", dens, lambda c, d: F.log(c + F.lit(alpha)) - d)

    def scores(self, alpha: float = 1.0) -> DataFrame:
        """``(fold, doc_id, label, prob)`` for every test document."""
        side = F.broadcast(self.stats)
        model = self.model.join(side, "fold").select("fold", *KEY, "df", self._weights(alpha).alias("w"))
        joined = skew_join(self._tests(), stage(model, "nb"), ["fold", *KEY])
        docs = self.docs.filter("fold >= 0").select("fold", "doc_id").join(side, "fold")
        return nb.label_scores(joined, docs, self.labels, F.col("prior"), ["fold", "doc_id"])

    def alpha_scores(self, alphas=tuple(nb.ALPHAS)) -> DataFrame:
        """``(alpha, accuracy)``: mean over folds, all settings in one pass."""
        k, m = len(self.labels), len(alphas)
        side = F.broadcast(self.stats)
        weights = F.flatten(F.array(*[self._weights(a) for a in alphas]))
        model = stage(self.model.join(side, "fold").select("fold", *KEY, "df", weights.alias("w")), "nb")
        joined = skew_join(self._tests(), model, ["fold", *KEY])
        sums = joined.groupBy("fold", "doc_id").agg(
            F.array(*[F.sum(F.col("value") * F.col("w")[i]) for i in range(k * m)]).alias("_s")
        )
        docs = self.docs.filter("fold >= 0").join(sums, ["fold", "doc_id"], "left").join(side, "fold")
        zero = nb._array([0.0] * (k * m))
        names = F.array(*[F.lit(v) for v in self.labels])
        grid = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(i * k + 1).alias("at")) for i, a in enumerate(alphas)])
        rows = docs.select("fold", "label", "prior", F.coalesce("_s", zero).alias("_s"), F.explode(grid).alias("g"))
        total = F.zip_with(F.slice("_s", F.col("g.at"), k), F.col("prior"), lambda s, p: s + p)
        rows = rows.select("fold", "label", "g.alpha", total.alias("_t"))
        # array_position gives the first, that is the smallest, label on a tie.
        best = F.element_at(names, F.array_position("_t", F.array_max("_t")).cast("int"))
        right = (best == F.col("label")).cast("double")
        per = rows.groupBy("alpha", "fold").agg(F.avg(right).alias("a"))
        return per.groupBy("alpha").agg(F.avg("a").alias("accuracy"))


def best_alpha(table: DataFrame) -> float:
    """The setting with the highest accuracy; the smallest one on a tie."""
    return table.orderBy(F.round("accuracy", 12).desc(), "alpha").first()["alpha"]


# ----------------------------------------------------------------- any learner


def cross_validate(
    features: DataFrame,
    labels: DataFrame,
    folds: DataFrame,
    train_and_score: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """``(fold, doc_id, label, prob)`` from one fit per fold.

    ``train_and_score(train_features, train_labels, test_features, test_docs)``
    gives ``(doc_id, label, prob)``; weights, pruning, selection and balance
    belong inside it, so that nothing of a test fold reaches its training.
    """
    keyed = stage(features.join(folds.select("doc_id", "fold"), "doc_id"), "cv_features")
    docs = stage(labels.join(folds.select("doc_id", "fold"), "doc_id"), "cv_labels")
    parts = []
    for fold in [r["fold"] for r in docs.select("fold").distinct().filter("fold >= 0").orderBy("fold").collect()]:
        train, test = F.col("fold") != fold, F.col("fold") == fold
        scores = train_and_score(
            keyed.filter(train).drop("fold"),
            docs.filter(train).drop("fold"),
            keyed.filter(test).drop("fold"),
            docs.filter(test).select("doc_id"),
        )
        parts.append(scores.select(F.lit(fold).alias("fold"), "doc_id", "label", "prob"))
    return reduce(DataFrame.unionByName, parts)

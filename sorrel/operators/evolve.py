"""Evolutionary search for feature subsets and smoothing settings.

A population is the table ``(cand_id, feature_id)`` of set bits beside
``(cand_id, alpha)``.  All draws are seeded hashes, and one Spark job scores
every candidate of a round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sorrel.functions.hashing import hash_unit
from sorrel.operators import many, report
from sorrel.operators.instances import in_order
from sorrel.plans.staging import Scratch, assign_position, drop_stage, rank_within, small_side, stage

MAXIMISED = ("precision_micro", "recall_micro", "f1_micro", "roc_auc")
METRICS = MAXIMISED + ("mae", "rmse")


def random_population(spark: SparkSession, n_features: int, size: int = 100, seed: int = 42) -> DataFrame:
    """Every bit is set with probability one half."""
    cells = spark.range(size).select(F.col("id").alias("cand_id"), F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("feature_id"))
    return cells.filter(hash_unit(seed, F.col("cand_id"), F.col("feature_id")) < 0.5)


def random_parameters(spark: SparkSession, options: list[float], size: int = 100, seed: int = 42) -> DataFrame:
    """One of the options per candidate."""
    draw = F.floor(hash_unit(f"{seed}_p", F.col("id")) * len(options)).cast("int")
    return spark.range(size).select(F.col("id").alias("cand_id"), F.array(*[F.lit(float(o)) for o in options])[draw].alias("alpha"))


def train_test_sample(labels: DataFrame, share: float = 0.8, steps: int = 1, seed: int = 42) -> DataFrame:
    """``(doc_id, label, train)``: whole blocks of ``steps`` neighbours.

    The split is stratified: blocks are ranked by a hash within the rarest label
    that they hold (the smallest one on a tie), and of each such group the share goes to the train part,
    but never the whole group.  With blocks of one document the test part so
    holds every label.
    """
    placed = assign_position(labels, [F.col("doc_id").asc()])
    counts = labels.groupBy("label").agg(F.count("*").alias("_n"))
    placed = stage(placed.withColumn("block", F.floor(F.col("pos") / steps)).join(small_side(counts), "label"), "blocks")
    blocks = placed.groupBy("block").agg(F.min(F.struct("_n", "label"))["label"].alias("stratum"))
    keyed = blocks.withColumn("_u", hash_unit(seed, F.col("block")))
    ranked = stage(rank_within(keyed, ["stratum"], [F.col("_u").asc(), F.col("block").asc()]), "ranked")
    sizes = ranked.groupBy("stratum").agg(F.count("*").alias("_size"))
    kept = F.least(F.floor(F.lit(share) * F.col("_size")), F.col("_size") - 1)
    side = ranked.join(small_side(sizes), "stratum").select("block", (F.col("rank") <= kept).alias("train"))
    return stage(placed.join(side, "block").select("doc_id", "label", "train"), "sample")


@dataclass
class Problem:
    """Train counts and grouped test documents of one sample."""

    labels: list
    counts: np.ndarray  # selected features x labels
    tests: DataFrame  # code, ids, vals


def prepare(vectors: DataFrame, sample: DataFrame, n_features: int) -> Problem:
    """Counts are selected features x labels numbers; documents stay in Spark."""
    order = in_order(r["label"] for r in sample.select("label").distinct().collect())
    code = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("label")) - 1
    coded = sample.withColumn("code", code)
    train = vectors.join(coded.filter("train"), "doc_id").groupBy("feature_id", "code").agg(F.sum("value").alias("n"))
    counts = np.zeros((n_features, len(order)))
    for r in train.collect():
        counts[r["feature_id"], r["code"]] = r["n"]
    pair = F.array_sort(F.collect_list(F.struct("feature_id", "value")))
    grouped = vectors.groupBy("doc_id").agg(pair.alias("_p"))
    tests = coded.filter("not train").join(grouped, "doc_id", "left").select(
        "code",
        F.coalesce(F.transform("_p", lambda x: x["feature_id"].cast("int")), F.array().cast("array<int>")).alias("ids"),
        F.coalesce(F.transform("_p", lambda x: x["value"]), F.array().cast("array<double>")).alias("vals"),
    )
    return Problem(order, counts, stage(tests, "tests"))


def _named(cells: DataFrame, labels: list, cands: list) -> DataFrame:
    """Confusion counts by candidate and label, from their numbers."""
    names = F.array(*[F.lit(str(v)) for v in labels])
    ids = F.array(*[F.lit(c).cast("long") for c in cands])
    return cells.groupBy("cand", "t", "p").agg(F.sum("n").alias("n")).select(
        ids[F.col("cand").cast("int")].alias("cand_id"), names[F.col("t").cast("int")].alias("target"),
        names[F.col("p").cast("int")].alias("prediction"), "n",
    )


def score_candidates(problem: Problem, population: DataFrame, params: DataFrame, metric: str = "f1_micro") -> DataFrame:
    """``(cand_id, fitness, n_features)`` of naive Bayes on every mask.

    Masks and train counts go to the tasks, which classify their documents
    under all candidates by matrix products and emit confusion counts only.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    alphas = {r["cand_id"]: r["alpha"] for r in params.collect()}
    cands = sorted(alphas)
    place = {c: i for i, c in enumerate(cands)}
    n_features, k = problem.counts.shape
    masks = np.zeros((len(cands), n_features))
    bits = population.groupBy("cand_id").agg(F.collect_list("feature_id").alias("ids"))
    for r in bits.collect():
        masks[place[r["cand_id"]], r["ids"]] = 1.0
    counts = problem.counts
    smooth = np.array([alphas[c] for c in cands])

    def classify(batches):
        table = np.zeros((len(cands), k, k), dtype=np.int64)
        groups = [(a, np.flatnonzero(smooth == a)) for a in np.unique(smooth)]
        size = masks.sum(axis=1)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                lengths = part["ids"].map(len).to_numpy()
                x = np.zeros((len(part), n_features))
                if lengths.sum():
                    x[np.repeat(np.arange(len(part)), lengths), np.concatenate(part["ids"].to_numpy()).astype(np.int64)] = np.concatenate(part["vals"].to_numpy())
                target = part["code"].to_numpy()
                for alpha, members in groups:
                    m = masks[members].T
                    length = x @ m
                    score = np.empty((k, len(part), len(members)))
                    for c in range(k):
                        total = counts[:, c] @ m + alpha * size[members]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            # A mask without features leaves only the prior.
                            score[c] = (x * np.log(counts[:, c] + alpha)) @ m - np.where(total > 0, length * np.log(np.where(total > 0, total, 1.0)), 0.0)
                    # Rounded, so that equal scores tie and the smallest label wins.
                    best = np.round(score, 9).argmax(axis=0)
                    for j, member in enumerate(members):
                        np.add.at(table[member], (target, best[:, j]), 1)
        c, t, p = np.nonzero(table)
        yield pd.DataFrame({"cand": c, "t": t, "p": p, "n": table[c, t, p]})

    cells = problem.tests.mapInPandas(classify, "cand long, t long, p long, n long")
    matrix = _named(cells, problem.labels, cands)
    spread = population.groupBy("cand_id").agg(F.count("*").alias("n_features"))
    return fitness(matrix, metric).join(spread, "cand_id", "left").fillna(0, ["n_features"])


# Classifiers whose candidates are linear models, and the loss of each.
LINEAR = {"logistic_regression": "logistic", "svm": "squared_hinge"}


@dataclass
class LinearProblem:
    """Packed rows of one sample."""

    labels: list
    train: DataFrame  # code, ids, vals
    tests: DataFrame
    size: int


def prepare_linear(vectors: DataFrame, sample: DataFrame, n_features: int) -> LinearProblem:
    order, rows = many.coded(sample)
    packed = many.packed_rows(vectors, rows)
    return LinearProblem(order, packed.filter("train"), packed.filter("not train"), n_features)


def score_linear_candidates(
    problem: LinearProblem, population: DataFrame, params: DataFrame, metric: str = "f1_micro", loss: str = "logistic", max_iter: int = 100
) -> DataFrame:
    """As :func:`score_candidates`, with a linear model of every candidate's features; ``alpha`` is its ``c``.

    All candidates and labels are fitted in the same passes over the train rows.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    strength = {r["cand_id"]: r["alpha"] for r in params.collect()}
    cands = sorted(strength)
    bits = {r["cand_id"]: tuple(r["ids"]) for r in population.groupBy("cand_id").agg(F.sort_array(F.collect_list("feature_id")).alias("ids")).collect()}
    specs, names = [], []
    for i, cand in enumerate(cands):
        for target in many.targets(problem.labels):
            specs.append(many.LinearSpec(target, strength[cand], loss=loss, columns=bits.get(cand, ())))
            names.append(i)
    models = many.fit_many(problem.train, problem.size, specs, max_iter)
    matrix = _named(many.confusion(problem.tests, models, problem.labels, names), problem.labels, cands)
    spread = population.groupBy("cand_id").agg(F.count("*").alias("n_features"))
    return fitness(matrix, metric).join(spread, "cand_id", "left").fillna(0, ["n_features"])


def fitness(matrix: DataFrame, metric: str) -> DataFrame:
    """``(cand_id, fitness)`` from confusion counts per candidate."""
    if metric in ("mae", "rmse"):
        diff = F.col("target").cast("double") - F.col("prediction").cast("double")
        error = F.abs(diff) if metric == "mae" else diff * diff
        mean = F.sum(error * F.col("n")) / F.sum("n")
        return matrix.groupBy("cand_id").agg((mean if metric == "mae" else F.sqrt(mean)).alias("fitness"))
    rates = report.micro_from_matrix(matrix, ["cand_id"])
    column = {"precision_micro": "pr", "recall_micro": "re", "f1_micro": "f1", "roc_auc": "auc"}[metric]
    return rates.select("cand_id", F.col(column).alias("fitness"))


def weighted_fitness(scored: DataFrame, n_features: int, metric: str = "f1_micro", weight: float = 0.0) -> DataFrame:
    """Fitness less (or, for errors, plus) the weighted share of features used."""
    share = F.col("n_features") / F.lit(float(n_features))
    if metric in MAXIMISED:
        value = (1 - weight) * F.col("fitness") - weight * share
    else:
        value = F.col("fitness") + weight * share
    return scored.withColumn("weighted", F.round(value, 6) + F.lit(0.0))


def _best_first(scored: DataFrame, metric: str) -> DataFrame:
    sign = -1 if metric in MAXIMISED else 1
    # A population is small, so its order may come from one task.
    return assign_position(scored.withColumn("_o", sign * F.col("weighted")), [F.col("_o").asc(), F.col("cand_id").asc()], "place").drop("_o")


def select_parents(scored: DataFrame, metric: str, n_pairs: int, elite: int, tournament: int = 2, seed: int = 42) -> DataFrame:
    """``(pair, side, cand_id)``: the best of ``tournament`` hash-drawn candidates.

    Contestants come from the candidates below the elite.
    """
    ranked = stage(_best_first(scored, metric), "ranked").select("cand_id", "place")
    size = ranked.count() - elite
    spark = scored.sparkSession
    draws = spark.range(n_pairs).select(F.col("id").alias("pair"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    draws = draws.select("pair", "side", F.explode(F.sequence(F.lit(0), F.lit(tournament - 1))).alias("draw"))
    pick = F.floor(hash_unit(f"{seed}_t", F.col("pair"), F.col("side"), F.col("draw")) * size).cast("long") + elite
    # The lower the place, the fitter the candidate.
    winners = draws.groupBy("pair", "side").agg(F.min(pick).alias("place"))
    return winners.join(F.broadcast(ranked), "place").select("pair", "side", "cand_id")


def _spliced(pair, probability: float, seed):
    """Whether a pair is crossed; if not, it hands its parents on as they are."""
    return hash_unit(f"{seed}_x", pair) < probability


def crossover(population: DataFrame, parents: DataFrame, n_features: int, points: int = 1, probability: float = 0.9, seed: int = 42) -> DataFrame:
    """``(child, feature_id)``: two children per pair, spliced at distinct hashed cuts.

    A pair that the probability passes over hands its parents on unchanged.
    """
    bits = parents.join(population, "cand_id").select("pair", "side", "feature_id")
    both = bits.select("pair", "side", "feature_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("twin"))
    child = F.col("pair") * 2 + F.col("twin")
    # Sorted draws, the j-th moved on by j, are never equal.
    draws = F.array_sort(F.array(*[F.floor(hash_unit(f"{seed}_c{j}", child) * (n_features - points + 1)) for j in range(points)]))
    passed = sum(((F.col("feature_id") >= draws[j] + j).cast("int") for j in range(points)), F.lit(0))
    keep = F.when(_spliced(F.col("pair"), probability, seed), passed % 2 == F.col("side")).otherwise(F.col("twin") == F.col("side"))
    return both.filter(keep).select(child.alias("child"), "feature_id")


def mutate(
    children: DataFrame, n_children: int, n_features: int, rate: float = 0.3, seed: int = 42, probability: float = 0.9
) -> DataFrame:
    """Flip each bit of the children of crossed pairs with probability ``rate``.

    ``probability`` and ``seed`` are those of :func:`crossover`; the children of pairs
    that were not crossed stay as they are.  A child that would end up empty
    gets one hashed bit.
    """
    spark = children.sparkSession
    ids = spark.range(n_children).select(F.col("id").alias("child"))
    crossed = ids.filter(_spliced(F.floor(F.col("child") / 2), probability, seed))
    cells = crossed.select("child", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("feature_id"))
    flips = cells.filter(hash_unit(f"{seed}_m0", F.col("child"), F.col("feature_id")) < rate)
    both = children.select("child", "feature_id").unionByName(flips)
    out = stage(both.groupBy("child", "feature_id").agg(F.count("*").alias("n")).filter("n = 1").drop("n"), "mutated")
    bit = F.floor(hash_unit(f"{seed}_m1", F.col("child")) * n_features).cast(out.schema["feature_id"].dataType)
    empty = ids.join(out.select("child").distinct(), "child", "left_anti").select("child", bit.alias("feature_id"))
    return out.unionByName(empty)


@dataclass
class Evolution:
    best_features: DataFrame  # cand_id, feature_id
    best_parameters: DataFrame  # cand_id, alpha
    rounds: DataFrame  # round, cand_id, fitness, n_features, weighted
    best: float


def evolve(
    vectors: DataFrame, labels: DataFrame, n_features: int, metric: str = "f1_micro", num_iterations: int = 300,
    population_size: int = 100, elite: float = 0.1, crossover_probability: float = 0.9, mutation_rate: float = 0.3,
    tournament_size: int = 2, n_crossovers: int = 1, stop_condition: int = 5, weight_feature_size: float = 0.0,
    alphas=(1.0,), sampling: bool = False, sample_share: float = 0.8, steps: int = 1, seed: int = 42, classifier: str = "naive_bayes",
) -> Evolution:
    """Rounds of score, select, splice and flip until no gain or the limit.

    Each round's population is a staged table, so lineage stays short and a
    lost executor costs no more than the round; what only the round needs is deleted
    after it.  ``classifier`` is ``naive_bayes`` or one of ``LINEAR``, for which ``alphas`` are values of ``c``.
    """
    if classifier != "naive_bayes" and classifier not in LINEAR:
        raise ValueError(f"no candidates of {classifier}")
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    posed = prepare if classifier == "naive_bayes" else prepare_linear

    def score(population, params):
        if classifier == "naive_bayes":
            return score_candidates(problem, population, params, metric)
        return score_linear_candidates(problem, population, params, metric, LINEAR[classifier])

    problem = posed(vectors, train_test_sample(labels, sample_share, steps, seed), n_features)
    population = stage(random_population(spark, n_features, population_size, seed), "population")
    params = stage(random_parameters(spark, list(alphas), population_size, seed), "params")
    n_elite = int(elite * population_size)
    n_pairs = -(-(population_size - n_elite) // 2)
    history, last, streak, turn, tops_of = [], None, 0, 0, None
    while True:
        scored = weighted_fitness(score(population, params), n_features, metric, weight_feature_size)
        scored = stage(scored.withColumn("round", F.lit(turn)), "scored")
        history.append(scored)
        values = {r["cand_id"]: r["weighted"] for r in scored.select("cand_id", "weighted").collect()}
        best = max(values.values()) if metric in MAXIMISED else min(values.values())
        better = last is None or (best > last if metric in MAXIMISED else best < last)
        last, streak = (best, 1) if better else (last, streak + 1)
        if better:
            # The features of the round that set the best value, which later rounds may not reach again.
            tops = [c for c, v in values.items() if v == best]
            winners = population.filter(F.col("cand_id").isin(tops)), params.filter(F.col("cand_id").isin(tops))
            if tops_of is not None:
                for table in tops_of:
                    drop_stage(table)
            tops_of = population, params
        if streak >= stop_condition or turn >= num_iterations:
            break
        turn += 1
        mark = f"{seed}_{turn}"
        old = population, params
        with Scratch() as made:
            parents = stage(select_parents(scored, metric, n_pairs, n_elite, tournament_size, mark), "parents")
            children = crossover(population, parents, n_features, n_crossovers, crossover_probability, mark)
            children = mutate(stage(children, "children"), 2 * n_pairs, n_features, mutation_rate, mark, crossover_probability)
            ranked = _best_first(scored, metric).filter(F.col("place") < n_elite).select("cand_id", "place")
            ranked = stage(ranked, "elite")
            kept = population.join(F.broadcast(ranked), "cand_id").select(F.col("place").alias("cand_id"), "feature_id")
            born = children.select((F.col("child") + n_elite).alias("cand_id"), "feature_id").filter(F.col("cand_id") < population_size)
            drawn = random_parameters(spark, list(alphas), population_size, mark).filter(F.col("cand_id") >= n_elite)
            # Children of a pair that was not crossed keep the parameters of their parent.
            own = parents.join(params, "cand_id").filter(~_spliced(F.col("pair"), crossover_probability, mark))
            own = own.select((F.col("pair") * 2 + F.col("side") + n_elite).alias("cand_id"), F.col("alpha").alias("_own"))
            drawn = drawn.join(own, "cand_id", "left").select("cand_id", F.coalesce("_own", "alpha").alias("alpha"))
            held = params.join(F.broadcast(ranked), "cand_id").select(F.col("place").alias("cand_id"), "alpha")
            population = stage(kept.unionByName(born), "population")
            params = stage(held.unionByName(drawn), "params")
            made.keep(population, params)
        if tops_of is None or tops_of[0] is not old[0]:
            for table in old:
                drop_stage(table)
        if sampling and int(np.random.default_rng(abs(hash_seed(mark))).integers(4)) == 0:
            problem = posed(vectors, train_test_sample(labels, sample_share, steps, mark), n_features)
    rounds = history[0]
    for scored in history[1:]:
        rounds = rounds.unionByName(scored)
    return Evolution(winners[0], winners[1], rounds, last)


def hash_seed(text: str) -> int:
    """A number from a seed text, the same in every process."""
    return sum((i + 1) * ord(c) for i, c in enumerate(text))


def evolution_report(rounds: DataFrame, metric: str = "f1_micro") -> DataFrame:
    """Mean, median, best and worst of each measure per round."""
    up = metric in MAXIMISED
    cols = []
    for name in ("fitness", "n_features", "weighted"):
        high, low = (F.max(name), F.min(name)) if up else (F.min(name), F.max(name))
        cols += [F.avg(name).alias(f"{name}_avg"), F.median(name).alias(f"{name}_median"), high.alias(f"{name}_best"), low.alias(f"{name}_worst")]
    return rounds.groupBy("round").agg(*cols)

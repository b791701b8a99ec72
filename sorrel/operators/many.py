"""Many linear models fitted in one pass over the rows per step.

Settings, folds, labels and feature masks form one axis of models.  A step reads
the staged rows once: every task adds the gradients of all models over its rows by
matrix products, the tasks' sums are added in two rounds, and the driver moves each
model by a limited-memory quasi-Newton step of its own.  A model follows the same
path as if it were fitted alone, and the number of jobs is that of the slowest model,
not of the axis.

Rows without features count with the intercept alone, models without rows stay
zero, and rows whose label is null train no model.  The driver holds models x
columns numbers; more models than ``PACK_BYTES`` allows are fitted pack after pack.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from sorrel.operators.instances import in_order
from sorrel.plans.staging import stage

# Bytes of weights that are fitted together, and cells of a dense block of rows inside a task.
PACK_BYTES = 32 * 1024 * 1024
BLOCK_CELLS = 2_000_000
LOSSES = ("logistic", "squared_hinge")


@dataclass(frozen=True)
class LinearSpec:
    """One binary model of the axis: rows with ``target`` against all others.

    Rows whose ``fold`` is the model's are held out; ``columns`` are the features it may use (all, if none are given).
    """

    target: int
    c: float = 1.0
    penalty: str = "l2"
    loss: str = "logistic"
    fold: int | None = None
    columns: tuple | None = field(default=None, repr=False)


def packed_rows(vectors: DataFrame, docs: DataFrame, name: str = "packed") -> DataFrame:
    """The columns of ``docs`` with ``ids`` and ``vals`` of each row's features, staged."""
    key = ["doc_id", "copy"] if "copy" in docs.columns else ["doc_id"]
    pair = F.array_sort(F.collect_list(F.struct(F.col("feature_id").cast("int").alias("i"), F.col("value").cast("double").alias("v"))))
    rows = docs.join(vectors.groupBy(*key).agg(pair.alias("_p")), key, "left")
    return stage(rows.select(
        *docs.columns,
        F.coalesce(F.transform("_p", lambda x: x["i"]), F.array().cast("array<int>")).alias("ids"),
        F.coalesce(F.transform("_p", lambda x: x["v"]), F.array().cast("array<double>")).alias("vals"),
    ), name)


def coded(labels: DataFrame) -> tuple[list, DataFrame]:
    """The labels in order, and their rows with ``code`` (-1 for a null label)."""
    order = in_order(r["label"] for r in labels.filter(F.col("label").isNotNull()).select("label").distinct().collect())
    code = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("label")) - 1
    return order, labels.withColumn("code", F.coalesce(code, F.lit(-1)).cast("int"))


def targets(order: list) -> list[int]:
    """Labels that need a model: one of two, or every one of more."""
    return [1] if len(order) == 2 else list(range(len(order)))


def dense_blocks(pdf: pd.DataFrame, models: int):
    """Pieces of a batch: its rows, the columns they use, and their dense matrix; rows x models stay bounded too."""
    lengths = pdf["ids"].map(len).to_numpy()
    ends = np.cumsum(lengths)
    at = 0
    while at < len(pdf):
        # A row uses no more columns than it has features.
        used = ends - (ends[at - 1] if at else 0)
        rows = np.arange(1, len(pdf) - at + 1)
        to = at + max(1, int(np.searchsorted(rows * np.maximum(used[at:], 1), BLOCK_CELLS, side="right")))
        to = min(to, at + max(1, BLOCK_CELLS // (4 * max(models, 1))))
        part, n = pdf.iloc[at:to], lengths[at:to]
        if n.sum():
            ids = np.concatenate(part["ids"].to_numpy()).astype(np.int64)
            cols, place = np.unique(ids, return_inverse=True)
            x = np.zeros((len(part), len(cols)))
            x[np.repeat(np.arange(len(part)), n), place] = np.concatenate(part["vals"].to_numpy()).astype(float)
        else:
            cols, x = np.zeros(0, np.int64), np.zeros((len(part), 0))
        yield part, cols, x
        at = to


def _losses(spec_is_hinge: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of every row and model at its signed margin, and the loss's slope."""
    gap = np.maximum(0.0, 1.0 - z)
    tail = np.exp(-np.abs(z))
    smooth = np.log1p(tail) + np.maximum(-z, 0.0)
    slope = -np.where(z >= 0, tail, 1.0) / (1.0 + tail)
    return np.where(spec_is_hinge, gap * gap, smooth), np.where(spec_is_hinge, -2.0 * gap, slope)


def _add_up(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(Summarizer.metrics("sum").summary(F.col("sums")).alias("s")).select(*keys, F.col("s.sum").alias("sums"))


def gradients(rows: DataFrame, specs: list[LinearSpec], weights: np.ndarray) -> np.ndarray:
    """For each model: summed loss, summed row weight, and the summed gradient (the last is the intercept's)."""
    n, width = weights.shape
    target = np.array([s.target for s in specs])
    held = np.array([-2 if s.fold is None else s.fold for s in specs])
    hinge = np.array([s.loss == "squared_hinge" for s in specs])
    folded, weighed = "fold" in rows.columns, "weight" in rows.columns

    def add(batches):
        out = np.zeros((n, width + 2))
        for pdf in batches:
            for part, cols, x in dense_blocks(pdf, n):
                code = part["code"].to_numpy()[:, None]
                sign = np.where(code == target[None, :], 1.0, -1.0)
                heavy = np.broadcast_to((code >= 0).astype(float), sign.shape)
                if weighed:
                    heavy = heavy * part["weight"].to_numpy()[:, None]
                if folded:
                    heavy = heavy * (part["fold"].to_numpy()[:, None] != held[None, :])
                z = x @ weights[:, cols].T + weights[:, -1]
                loss, slope = _losses(hinge[None, :], sign * z)
                pull = heavy * slope * sign
                out[:, 0] += (heavy * loss).sum(axis=0)
                out[:, 1] += heavy.sum(axis=0)
                out[:, cols + 2] += pull.T @ x
                out[:, -1] += pull.sum(axis=0)
        yield pd.DataFrame({"model": np.arange(n), "sums": list(out)})

    needed = ["code", *(["fold"] if folded else []), *(["weight"] if weighed else []), "ids", "vals"]
    parts = rows.select(*needed).mapInPandas(add, "model int, sums array<double>")
    # Added in two rounds, so that no task takes the sums of all others.
    group = F.spark_partition_id() % 32
    halves = _add_up(parts.select("model", group.alias("part"), array_to_vector("sums").alias("sums")), "model", "part")
    out = np.zeros((n, width + 2))
    for r in _add_up(halves, "model").collect():
        out[r["model"]] = r["sums"].toArray()
    return out


class Descent:
    """Quasi-Newton descent of one model, which is told the loss and gradient at ``point``.

    Penalties leave the intercept, the last number, alone.  With an absolute penalty
    steps stay in one orthant (Andrew & Gao 2007).
    """

    def __init__(self, width: int, columns: np.ndarray | None, max_iter: int, tol: float, memory: int = 10):
        self.open = np.ones(width, dtype=bool)
        if columns is not None:
            self.open[:-1] = False
            self.open[columns] = True
        self.point = np.zeros(width)
        self.best = self.value = self.slope = None
        self.max_iter, self.tol, self.memory = max_iter, tol, memory
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.turn, self.halvings, self.done = 0, 0, False

    def _downhill(self, slope: np.ndarray, at: np.ndarray, l1: np.ndarray) -> np.ndarray:
        """The gradient with the absolute penalty's: its smallest subgradient at zero."""
        up, down = slope + l1, slope - l1
        return np.where(at > 0, up, np.where(at < 0, down, np.where(up < 0, up, np.where(down > 0, down, 0.0))))

    def _direction(self, pull: np.ndarray, l1: np.ndarray) -> np.ndarray:
        q, past = pull.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            past.append(a)
            q -= a * y
        if self.steps:
            s, y = self.steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.steps, reversed(past)):
            q += s * (a - (y @ q) / (s @ y))
        # Under an absolute penalty no coordinate goes against its own slope.
        return np.where((l1 > 0) & (q * pull <= 0), 0.0, -q)

    def _try(self, length: float) -> None:
        self.length = length
        moved = self.best + length * self.way
        self.point = np.where((self.l1 > 0) & (np.sign(moved) != self.orthant), 0.0, moved)

    def _start_step(self) -> None:
        self.pull = self._downhill(self.slope, self.best, self.l1)
        if self.turn >= self.max_iter or np.abs(self.pull).max() <= self.tol:
            self.done, self.point = True, self.best
            return
        self.way = self._direction(self.pull, self.l1)
        if self.way @ self.pull >= 0:
            self.steps.clear()
            self.way = -self.pull
        self.orthant = np.where(self.best != 0, np.sign(self.best), -np.sign(self.pull))
        self.halvings = 0
        self._try(1.0 if self.steps else min(1.0, 1.0 / np.linalg.norm(self.pull)))

    def tell(self, loss: float, slope: np.ndarray, l1: float, l2: float) -> None:
        self.l1 = np.full(len(self.point), l1)
        self.l1[-1] = 0.0
        flat = self.point.copy()
        flat[-1] = 0.0
        value = loss + l2 / 2 * flat @ flat + l1 * np.abs(flat).sum()
        slope = np.where(self.open, slope + l2 * flat, 0.0)
        self.l1[~self.open] = 0.0
        if self.best is None:
            self.best, self.value, self.slope = self.point, value, slope
            self._start_step()
            return
        if value > self.value + 1e-4 * self.pull @ (self.point - self.best):
            self.halvings += 1
            if self.halvings > 30:
                self.done, self.point = True, self.best
            else:
                self._try(self.length / 2)
            return
        s, y = self.point - self.best, slope - self.slope
        if s @ y > 1e-12 * (y @ y):
            self.steps = [*self.steps, (s, y)][-self.memory :]
        self.turn += 1
        self.best, self.value, self.slope = self.point, value, slope
        self._start_step()


@dataclass
class ManyModels:
    specs: list[LinearSpec]
    weights: np.ndarray  # models x (columns + 1), the last is the intercept
    passes: int  # over the rows


def fit_many(rows: DataFrame, size: int, specs: list[LinearSpec], max_iter: int = 1000, tol: float = 1e-6) -> ManyModels:
    """Fit every model on ``rows(code, ids, vals[, weight, fold])`` with ids below ``size``.

    The penalty is 1 / (c x weight of the model's rows), as in a fit of its own.
    """
    for s in specs:
        if s.loss not in LOSSES or s.penalty not in ("l1", "l2"):
            raise ValueError(f"unknown loss or penalty: {s.loss}, {s.penalty}")
    pack = max(1, PACK_BYTES // (8 * (size + 3)))
    found, passes = np.zeros((len(specs), size + 1)), 0
    for at in range(0, len(specs), pack):
        part = specs[at : at + pack]
        runs = [Descent(size + 1, None if s.columns is None else np.asarray(s.columns, np.int64), max_iter, tol) for s in part]
        while live := [i for i, r in enumerate(runs) if not r.done]:
            sums = gradients(rows, [part[i] for i in live], np.stack([runs[i].point for i in live]))
            passes += 1
            for i, row in zip(live, sums):
                if row[1] <= 0:
                    runs[i].done = True
                    continue
                strength = 1.0 / (part[i].c * row[1])
                l1, l2 = (strength, 0.0) if part[i].penalty == "l1" else (0.0, strength)
                runs[i].tell(row[0] / row[1], row[2:] / row[1], l1, l2)
        found[at : at + len(part)] = [r.point for r in runs]
    return ManyModels(specs, found, passes)


def held_out_scores(rows: DataFrame, models: ManyModels, order: list, names: list[int]) -> DataFrame:
    """``(setting, doc_id, label, prob)`` of each row's own fold, in one pass.

    ``names`` holds the setting of each model; a setting's models of one fold are in the order of :func:`targets`.  Logistic values are divided by their sum where there are more than two labels.
    """
    weights = models.weights
    place: dict[int, dict[int, list[int]]] = {}
    for i, (name, spec) in enumerate(zip(names, models.specs)):
        place.setdefault(spec.fold, {}).setdefault(name, []).append(i)
    k = len(order)

    def tell(batches):
        for pdf in batches:
            for part, cols, x in dense_blocks(pdf, len(weights)):
                fold, docs = part["fold"].to_numpy(), part["doc_id"].to_numpy()
                for f in np.unique(fold):
                    mine = np.flatnonzero(fold == f)
                    for name, members in place.get(int(f), {}).items():
                        z = x[mine] @ weights[np.ix_(members, cols)].T + weights[members, -1]
                        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                        if k == 2:
                            p = np.concatenate([1 - p, p], axis=1)
                        else:
                            total = p.sum(axis=1, keepdims=True)
                            p = np.where(total > 0, p / np.where(total > 0, total, 1.0), 1.0 / k)
                        yield pd.DataFrame({
                            "setting": name, "doc_id": np.repeat(docs[mine], k), "code": np.tile(np.arange(k), len(mine)), "prob": p.ravel(),
                        })

    kind = rows.schema["doc_id"].dataType.simpleString()
    told = rows.select("doc_id", "fold", "ids", "vals").mapInPandas(tell, f"setting int, doc_id {kind}, code int, prob double")
    return told.select("setting", "doc_id", F.array(*[F.lit(v) for v in order])[F.col("code")].alias("label"), "prob")


def confusion(rows: DataFrame, models: ManyModels, order: list, names: list[int]) -> DataFrame:
    """``(cand, t, p, n)``: confusion counts of each candidate's models on ``rows(code, ids, vals)``.

    Margins are rounded, so that equal ones tie and the smallest label wins.
    """
    weights, k = models.weights, len(order)
    members: dict[int, list[int]] = {}
    for i, name in enumerate(names):
        members.setdefault(name, []).append(i)

    def tell(batches):
        table = {name: np.zeros((k, k), dtype=np.int64) for name in members}
        for pdf in batches:
            for part, cols, x in dense_blocks(pdf, len(weights)):
                target = part["code"].to_numpy()
                known = target >= 0
                z = np.round(x @ weights[:, cols].T + weights[:, -1], 9)
                for name, at in members.items():
                    best = (z[:, at[0]] > 0).astype(int) if k == 2 else z[:, at].argmax(axis=1)
                    np.add.at(table[name], (target[known], best[known]), 1)
        for name, cells in table.items():
            t, p = np.nonzero(cells)
            yield pd.DataFrame({"cand": name, "t": t, "p": p, "n": cells[t, p]})

    return rows.select("code", "ids", "vals").mapInPandas(tell, "cand long, t long, p long, n long")

"""Second-order gradient boosting on histograms of sparse rows.

Values are cut into at most ``BINS`` bins a column, at quantiles from a mergeable
sketch.  A level of a tree is one job: every task walks its documents to the open
nodes and sums gradients and hessians by (label, node, column, bin), the sums
are added, and running sums over the bins give the best split of every node.  All labels' trees grow in the same jobs.

An absent value is no bin: every split sends it the way that gains more.  A leaf
weighs -T(G) / (H + lambda), T taking ``reg_alpha`` off; a split gains the
difference of T(G)^2 / (H + lambda) and is made if that is at least ``gamma`` and both sides have
hessian sums of ``min_child_weight`` or more.  Ties go to the smaller column, then the lower bin,
then absent values to the left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sorrel.functions.hashing import hash_unit
from sorrel.operators.instances import in_order
from sorrel.plans.staging import drop_stage, fits, small_side, stage

BINS = 256
# Trees after which the documents' sums are written, so that a job walks no more than these.
WRITTEN = 10
# Gains that are rounding errors of the sums.
LEAST_GAIN = 1e-6
# Partial sums of a level that the driver adds itself.
DRIVER_CELLS = 500_000
# Cells of a dense table of a batch's values or of a level's sums; wider ones are searched and sorted.
GRID = 8_000_000
# Rows and bytes of a table that one task goes through.
SMALL_ROWS, SMALL_BYTES = 20_000, 8 * 1024 * 1024
CELLS = pa.schema([("cls", pa.int32()), ("node", pa.int32()), ("f", pa.int32()), ("b", pa.int32()), ("g", pa.float64()), ("h", pa.float64())])


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has column -1, the right child follows the left one."""

    column: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    absent_left: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [-1])
    weight: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, cut: float, absent_left: bool) -> int:
        """Give a leaf two children; returns the left one."""
        at = len(self.column)
        self.column[node], self.cut[node], self.absent_left[node], self.left[node] = column, cut, absent_left, at
        for _ in range(2):
            for name, value in (("column", -1), ("cut", 0.0), ("absent_left", False), ("left", -1), ("weight", 0.0)):
                getattr(self, name).append(value)
        return at

    def leaves(self, cells: Cells) -> np.ndarray:
        """Leaf of each row of a batch."""
        column, cut, left = np.array(self.column), np.array(self.cut), np.array(self.left)
        absent_left, at = np.array(self.absent_left), np.zeros(cells.n, np.int64)
        while len(rows := np.flatnonzero(column[at] >= 0)):
            node = at[rows]
            given, value = cells.at(rows, column[node])
            at[rows] = left[node] + ~np.where(given, value < cut[node], absent_left[node])
        return at


class Cells:
    """Row, column and value of the cells of a batch of sparse rows, and a way to look one up."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        lists = batch.column(batch.schema.get_field_index("ids"))
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.n, self.size, self.row = len(sizes), size, np.repeat(np.arange(len(sizes)), sizes)
        self.column = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = batch.column(batch.schema.get_field_index("vals")).flatten().to_numpy(zero_copy_only=False)
        # Keys are sorted; of a repeated one the first cell counts.
        self.keys, self.dense = self.row * size + self.column, self.n * size <= GRID
        if self.dense:
            self.given, self.grid = np.zeros(self.n * size, bool), np.zeros(self.n * size, self.values.dtype)
            self.given[self.keys], self.grid[self.keys[::-1]] = True, self.values[::-1]

    def at(self, rows: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row has a cell in its column, and the value."""
        want = rows * self.size + column
        if self.dense:
            return self.given[want], self.grid[want]
        if not len(self.keys):
            return np.zeros(len(want), bool), np.zeros(len(want))
        place = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return self.keys[place] == want, self.values[place]


def _number_lists(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def sparse_rows(vectors: DataFrame, docs: DataFrame, value: Column, kind: str = "double") -> DataFrame:
    """``docs`` with ``ids`` and ``vals``, the sorted columns and the values of each row's cells."""
    key = ["doc_id", "copy"] if "copy" in docs.columns else ["doc_id"]
    cells = F.array_sort(F.collect_list(F.struct(F.col("feature_id").cast("int").alias("i"), value.alias("v"))))
    rows = docs.join(vectors.groupBy(*key).agg(cells.alias("_p")), key, "left")
    return rows.select(
        *docs.columns, F.coalesce(F.transform("_p", lambda x: x["i"]), F.array().cast("array<int>")).alias("ids"),
        F.coalesce(F.transform("_p", lambda x: x["v"].cast(kind)), F.array().cast(f"array<{kind}>")).alias("vals"),
    )


def bin_edges(vectors: DataFrame, bins: int = BINS) -> DataFrame:
    """``(feature_id, edges)``: lower edges of the bins, from a quantile sketch of the present values."""
    parts = [i / bins for i in range(bins + 1)]
    return vectors.groupBy("feature_id").agg(F.array_sort(F.array_distinct(F.percentile_approx("value", parts, 40 * bins))).alias("edges"))


@dataclass
class BoostedTrees:
    """Fitted trees: for every round one of each label, or one in all for two labels."""

    labels: list
    size: int
    rounds: list
    gains: dict
    settings: dict = field(default_factory=dict)

    def scores(self, vectors: DataFrame, docs: DataFrame) -> DataFrame:
        """``(doc_id, label, prob)``; of more than two labels the normalised one-against-the-rest shares."""
        rows = sparse_rows(vectors, docs.select("doc_id"), F.col("value"))
        rounds, size, k = self.rounds, self.size, len(self.labels)
        key = next(f for f in rows.schema.fields if f.name == "doc_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = 1 / (1 + np.exp(-_margins(rounds, Cells(batch, size))))
                p = np.column_stack((1 - p, p)) if k == 2 else p / p.sum(axis=1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), lists], ["doc_id", "_p"])

        found = rows.mapInArrow(run, f"doc_id {key.dataType.simpleString()}, _p array<double>")
        pairs = F.arrays_zip(F.array(*map(F.lit, self.labels)).alias("label"), F.col("_p").alias("prob"))
        return found.select("doc_id", F.explode(pairs).alias("_z")).select("doc_id", "_z.label", "_z.prob")

    def importance(self) -> dict:
        """Mean gain of the splits of every column, as shares of their sum."""
        mean = {f: total / n for f, (total, n) in self.gains.items()}
        whole = sum(mean.values())
        return {f: g / whole for f, g in mean.items()} if whole else {}


def _margins(rounds: list, cells: Cells, start: np.ndarray | None = None) -> np.ndarray:
    width = len(rounds[0]) if rounds else 1
    out = np.zeros((cells.n, width)) if start is None else start.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            out[:, c] += np.array(tree.weight)[tree.leaves(cells)]
    return out


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (key, g, h) added up by key."""
    rows = np.concatenate(parts, axis=1)
    key, at = np.unique(rows[0].astype(np.int64), return_inverse=True)
    return np.stack((key, np.bincount(at, rows[1], len(key)), np.bincount(at, rows[2], len(key))))


def level_sums(rows: DataFrame, rounds: list, growing: list[Tree], open_nodes: list[dict], size: int, drawn: float, weight: float) -> DataFrame:
    """``(cls, node, f, b, g, h)``: gradient and hessian of the open nodes' cells, in partial sums; column -1 is the node's own.

    ``drawn`` is the share of the documents whose ``_u`` lets them take part.
    """
    bins = BINS + 1
    width = (size + 1) * bins
    dense = width * sum(map(len, open_nodes)) <= GRID

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {c: [] for c in range(len(growing))}
        for batch in batches:
            cells = Cells(batch, size)
            margin = _margins(rounds, cells, _number_lists(batch, "margin"))
            codes = batch.column(batch.schema.get_field_index("code")).to_numpy(zero_copy_only=False)
            part = batch.column(batch.schema.get_field_index("_u")).to_numpy(zero_copy_only=False) < drawn
            place = (cells.column + 1) * bins + cells.values.astype(np.int64)
            for c, tree in enumerate(growing):
                if not open_nodes[c]:
                    continue
                y = (codes == (1 if len(growing) == 1 else c)).astype(float)
                p = 1 / (1 + np.exp(-margin[:, c]))
                w = np.where(y == 1, weight, 1.0)
                number = np.full(len(tree.column), -1)
                number[list(open_nodes[c])] = list(open_nodes[c].values())
                node = np.where(part, number[tree.leaves(cells)], -1)
                g, h = (p - y) * w, np.maximum(p * (1 - p), 1e-16) * w
                own, cell = node >= 0, node[cells.row] >= 0
                row = cells.row[cell]
                at = np.concatenate((node[own] * width, node[row] * width + place[cell]))
                g, h = np.concatenate((g[own], g[row])), np.concatenate((h[own], h[row]))
                if not dense:
                    sums[c].append(_summed([np.stack((at, g, h))]))
                    continue
                most = len(open_nodes[c]) * width
                if not sums[c]:
                    sums[c] = [np.zeros(most, bool), np.zeros(most), np.zeros(most)]
                sums[c][0][at] = True
                sums[c][1] += np.bincount(at, g, most)
                sums[c][2] += np.bincount(at, h, most)
        for c, parts in sums.items():
            if parts:
                key, g, h = (np.flatnonzero(parts[0]), *(x[parts[0]] for x in parts[1:])) if dense else _summed(parts)
                key = key.astype(np.int64)
                columns = [np.full(len(key), c), key // width, key // bins % (size + 1) - 1, key % bins]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in columns), pa.array(g), pa.array(h)], schema=CELLS)

    return rows.mapInArrow(run, "cls int, node int, f int, b int, g double, h double")


def split_of(f: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, reg_lambda: float, reg_alpha: float, least: float) -> tuple:
    """Sums ``(g, h)`` of a node and its best split ``(gain, column, bin, absent_left, gl, hl)`` from its cells; gain -inf without one."""
    order = np.lexsort((b, f))
    f, b, g, h = f[order], b[order], g[order], h[order]
    own = np.searchsorted(f, 0)
    whole_g, whole_h = g[:own].sum(), h[:own].sum()
    f, b, g, h = f[own:], b[own:], g[own:], h[own:]
    if not len(f):
        return whole_g, whole_h, -np.inf, -1, 0, False, 0.0, 0.0
    first, last = np.searchsorted(f, f), np.searchsorted(f, f, "right")
    run_g, run_h = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    low_g, low_h = run_g[:-1] - run_g[first], run_h[:-1] - run_h[first]
    absent_g, absent_h = whole_g - (run_g[last] - run_g[first]), whole_h - (run_h[last] - run_h[first])
    gl, hl = np.column_stack((low_g + absent_g, low_g)), np.column_stack((low_h + absent_h, low_h))
    gr, hr = whole_g - gl, whole_h - hl

    def worth(x, y):
        return np.maximum(np.abs(x) - reg_alpha, 0) ** 2 / (y + reg_lambda)

    good = (hl >= least) & (hr >= least) & (hl > 1e-12) & (hr > 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Equal gains differ by rounding of their sums only.
        gain = np.where(good, np.round(worth(gl, hl) + worth(gr, hr) - worth(whole_g, whole_h), 9), -np.inf)
    at, side = divmod(int(gain.argmax()), 2)
    return whole_g, whole_h, gain[at, side], int(f[at]), int(b[at]), side == 0, gl[at, side], hl[at, side]


def best_splits(sums: DataFrame, cells: int, *limits: float) -> list[tuple]:
    """``(cls, node, *split_of)`` of every open node.

    Up to ``DRIVER_CELLS`` partial sums are added on the driver.  More are shuffled by node, once; a task adds a node's
    partial sums, no more than the model has bins from every task, and finds its split; one row a node comes back.
    """
    if cells <= DRIVER_CELLS:
        table = sums.toPandas()
        return [(*key, *_split_of_group(group, limits)) for key, group in table.groupby(["cls", "node"])]

    def best(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*(int(x) for x in key), *_split_of_group(group, limits))])

    schema = "cls int, node int, gs double, hs double, gain double, f int, b int, absent_left boolean, gl double, hl double"
    return [tuple(r) for r in sums.groupBy("cls", "node").applyInPandas(best, schema).collect()]


def _split_of_group(group: pd.DataFrame, limits: tuple) -> tuple:
    key = (group["f"].to_numpy(np.int64) + 1) * (BINS + 1) + group["b"].to_numpy(np.int64)
    key, g, h = _summed([np.stack((key, group["g"], group["h"]))])
    key = key.astype(np.int64)
    return split_of(key // (BINS + 1) - 1, key % (BINS + 1), g, h, *limits)


def fit_boosted(
    vectors: DataFrame, labels: DataFrame, size: int, learning_rate: float = 0.1, min_child_weight: float = 1, max_depth: int = 6, gamma: float = 0.0,
    subsample: float = 1.0, colsample_bytree: float = 1.0, scale_pos_weight: float = 1.0, seed: int = 7, n_estimators: int = 100,
    reg_lambda: float = 1.0, reg_alpha: float = 0.0,
) -> BoostedTrees:
    """Boosted trees, one against the rest beyond two labels."""
    order = in_order(r["label"] for r in labels.select("label").distinct().collect())
    k = 1 if len(order) == 2 else len(order)
    edges = stage(bin_edges(vectors.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")), "edges")
    # As many edges as the model may have cuts: at most BINS + 1 for every column.
    cuts = {r["feature_id"]: r["edges"] for r in edges.collect()}
    binned = vectors.join(small_side(edges), "feature_id").withColumn(
        "bin", F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1
    )
    code = (F.array_position(F.array(*map(F.lit, order)), F.col("label")) - 1).cast("int")
    keyed = labels.withColumn("code", code).withColumn("margin", F.array_repeat(F.lit(0.0), k))
    rows = stage(sparse_rows(binned, keyed, F.col("bin"), "smallint"), "boosted")
    small = fits(rows, SMALL_ROWS, SMALL_BYTES)
    width, parts = 1 + sum(map(len, cuts.values())), 1 if small else rows.select(F.spark_partition_id()).distinct().count()
    finished, done, gains = [], [], {}
    for t in range(n_estimators):
        trees, columns = [Tree() for _ in range(k)], None
        # A task has a fixed cost a level, which outweighs the work on a small table.
        drawn = (rows.coalesce(1) if small else rows).withColumn("_u", hash_unit(seed + t, F.col("doc_id")) if subsample < 1 else F.lit(0.0))
        if colsample_bytree < 1:
            n = max(1, round(size * colsample_bytree))
            columns = np.sort(np.random.default_rng((seed, t)).permutation(size)[:n])
        level: list[dict] = [{0: 0} for _ in range(k)]
        for _ in range(max_depth):
            if not any(level):
                break
            sums = level_sums(drawn, done, trees, level, size, subsample, scale_pos_weight)
            if columns is not None:
                sums = sums.filter(F.col("f").isin([-1, *columns.tolist()]))
            cells = parts * width * sum(map(len, level))
            found = best_splits(sums, cells, reg_lambda, reg_alpha, min_child_weight)
            names = [{n: node for node, n in nodes.items()} for nodes in level]
            level = [{} for _ in range(k)]
            for c, number, g, h, gain, column, cut, absent_left, gl, hl in sorted(found, key=lambda r: r[:2]):
                tree, node = trees[c], names[c][number]
                tree.weight[node] = _weight(g, h, reg_lambda, reg_alpha) * learning_rate
                if gain <= LEAST_GAIN or gain < gamma:
                    continue
                left = tree.split(node, column, float(cut), bool(absent_left))
                total, n = gains.get(column, (0.0, 0))
                gains[column] = (total + float(gain), n + 1)
                for child, g_, h_ in ((left, gl, hl), (left + 1, g - gl, h - hl)):
                    tree.weight[child] = _weight(g_, h_, reg_lambda, reg_alpha) * learning_rate
                    level[c][child] = len(level[c])
        done.append(trees)
        if len(done) == WRITTEN and t + 1 < n_estimators:
            rows, old = stage(_with_margins(rows, done, size), "boosted"), rows
            drop_stage(old)
            finished, done = finished + done, []
    rounds = finished + done
    drop_stage(rows)
    for trees in rounds:
        for tree in trees:
            tree.cut = [cuts[f][int(b)] if f >= 0 else 0.0 for f, b in zip(tree.column, tree.cut, strict=True)]
    settings = {
        "learning_rate": learning_rate, "min_child_weight": min_child_weight, "max_depth": max_depth, "gamma": gamma, "subsample": subsample,
        "colsample_bytree": colsample_bytree, "scale_pos_weight": scale_pos_weight, "seed": seed, "n_estimators": n_estimators,
        "reg_lambda": reg_lambda, "reg_alpha": reg_alpha,
    }
    return BoostedTrees(order, size, rounds, gains, settings)


def _weight(g: float, h: float, reg_lambda: float, reg_alpha: float) -> float:
    return float(-np.sign(g) * max(abs(g) - reg_alpha, 0.0) / (h + reg_lambda))


def _with_margins(rows: DataFrame, rounds: list, size: int) -> DataFrame:
    """The documents with the sums of their trees so far."""
    at = rows.columns.index("margin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = _margins(rounds, Cells(batch, size), _number_lists(batch, "margin"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, new.shape[1]), pa.int32()), pa.array(new.ravel()))
            yield pa.RecordBatch.from_arrays([lists if i == at else x for i, x in enumerate(batch.columns)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)

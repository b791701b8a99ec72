"""Exact k-nearest-neighbour classification, block against block.

Every task reads some blocks of test rows and some of train rows from the staged tables, so that neither is copied
by a shuffle.  Distances between two blocks are measured inside a task, first roughly in single
precision (the euclidean ones by one matrix product), with a bound of the error; rows that the bound
leaves among the k best so far are measured exactly.  Only the k best of all the task's train rows leave
it for each test row; no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sorrel.operators.instances import label_list
from sorrel.plans.staging import assign_position, small_batches, stage, stage_freed, staged_bytes

# Rows of a train block and of a test block, and test rows that are measured at once.
TRAIN_BLOCK = 2048
TEST_BLOCK = 2048
STRIP = 512
# Bytes of train blocks and number of test blocks that a task reads, and bytes of dense train blocks that it keeps.
TRAIN_BYTES, TEST_BLOCKS, KEPT_BYTES = 32 * 1024 * 1024, 8, 64 * 1024 * 1024
# Cells of a tile of differences, and the largest whole power that is measured roughly.
TILE, MOST_POWER = 65_536, 8


def _blocks(vectors: DataFrame, docs: DataFrame, size: int, extra: list[str], mark: str) -> DataFrame:
    """Documents packed ``size`` to a block as flat lists whose names start with ``mark``; ``sizes`` counts each document's cells."""
    pair = F.collect_list(F.struct("feature_id", "value"))
    sparse = vectors.groupBy("doc_id").agg(pair.alias("_p"))
    placed = assign_position(docs.join(sparse, "doc_id", "left"), [F.col("doc_id").asc()])
    row = F.struct(
        "doc_id",
        *extra,
        F.coalesce(F.transform("_p", lambda x: x["feature_id"].cast("int")), F.array().cast("array<int>")).alias("ids"),
        F.coalesce(F.transform("_p", lambda x: x["value"].cast("double")), F.array().cast("array<double>")).alias("vals"),
    )
    block = F.floor(F.col("pos") / size)
    packed = placed.groupBy(block.alias("block")).agg(F.collect_list(row).alias("rows"))
    return packed.select(
        "block", *[F.col(f"rows.{c}").alias(f"{mark}{c}") for c in ("doc_id", *extra)], F.transform("rows.ids", lambda x: F.size(x)).alias(f"{mark}sizes"),
        F.flatten("rows.ids").alias(f"{mark}ids"), F.flatten("rows.vals").alias(f"{mark}vals"),
    )


def _dense(sizes: np.ndarray, ids: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(sizes), size))
    out[np.repeat(np.arange(len(sizes)), sizes), ids] = values
    return out


def _lengths(diff: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances from differences along the last axis."""
    if metric == "euclidean":
        return np.sqrt(np.einsum("...k,...k->...", diff, diff))
    if metric == "manhattan":
        return np.abs(diff).sum(axis=-1)
    if metric == "hamming":
        return (diff != 0).mean(axis=-1)
    return (np.abs(diff) ** p).sum(axis=-1) ** (1.0 / p)


def _distances(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for at in range(0, len(a), step):
        out[at : at + step] = _lengths(a[at : at + step, None, :] - b[None, :, :], metric, p)
    return out


def _powers(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Sums of the p-th powers of the differences, column by column in tiles that stay in a core's cache."""
    out = np.zeros((len(a), len(b)), np.float32)
    columns_a, columns_b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    step = max(1, TILE // max(1, len(b)))
    held, power = np.empty((2, min(step, len(a)), len(b)), np.float32)
    for at in range(0, len(a), step):
        sums = out[at : at + step]
        diff, term = held[: len(sums)], power[: len(sums)]
        for x, y in zip(columns_a[:, at : at + step], columns_b, strict=True):
            np.subtract(x[:, None], y, out=diff)
            np.abs(diff, out=diff)
            if p > 1:
                np.multiply(diff, diff, out=term)
                for _ in range(p - 2):
                    np.multiply(term, diff, out=term)
            sums += diff if p == 1 else term
    return out


def _rough(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> tuple[np.ndarray, float] | None:
    """Powers of all distances in single precision, and more than any of them is off; None where that cannot be told."""
    power = {"euclidean": 2, "manhattan": 1}.get(metric, p)
    if metric == "hamming" or power != int(power) or not 1 <= power <= MOST_POWER:
        return None
    power, (near, far) = int(power), (x.astype(np.float32) for x in (a, b))
    with np.errstate(over="ignore", invalid="ignore"):
        if metric == "euclidean":
            found = near @ far.T
            found *= -2
            found += np.einsum("ij,ij->i", near, near)[:, None]
            found += np.einsum("ij,ij->i", far, far)
        else:
            found = _powers(near, far, power)
        most = float((np.abs(a) ** power).sum(axis=1).max() + (np.abs(b) ** power).sum(axis=1).max())
        off = _off(a.shape[1], power, most)
    return (found, off) if np.isfinite(found).all() and np.isfinite(off) and off < np.finfo(np.float32).max else None


def _off(size: int, power: int, most: float) -> float:
    """More than a sum of ``size`` powers in single precision is off, if both rows' powers add up to ``most``."""
    return 2.0**-21 * (size + 8) * power * 2 ** (power - 1) * most + 1e-36 * size


def nearest(
    train: DataFrame,
    train_docs: DataFrame,
    test: DataFrame,
    test_docs: DataFrame,
    size: int,
    k: int = 3,
    metric: str = "euclidean",
    p: float = 2.0,
    train_block: int | None = None,
    test_block: int = TEST_BLOCK,
) -> DataFrame:
    """``(doc_id, neighbour, label, distance, place)``: the k nearest train rows.

    ``train_docs(doc_id, label)`` and ``test_docs(doc_id)``, vectors by
    ``feature_id`` below ``size``.  Both tables may carry ``fold``: a test
    document then meets the train documents of the other folds.
    """
    if metric not in ("euclidean", "manhattan", "minkowski", "hamming"):
        raise ValueError(f"unknown metric: {metric}")
    train_block = train_block or max(64, min(TRAIN_BLOCK, 4_000_000 // max(size, 1)))
    folded = "fold" in train_docs.columns and "fold" in test_docs.columns
    mark = ["fold"] if folded else []
    small_batches(train.sparkSession)
    left = stage_freed(_blocks(train, train_docs, train_block, ["label", *mark], "a_"), "train_blocks")
    right = stage_freed(_blocks(test, test_docs, test_block, mark, "b_"), "test_blocks")
    n_left, n_right = left.count(), right.count()
    # A task gets a part of the test blocks and one of the train blocks; both are shuffled once, whatever the number of pairs.
    parts = max(1, min(n_left, -(-staged_bytes(left) // TRAIN_BYTES)))
    most = max(-(-n_right // TEST_BLOCKS), -(-2 * train.sparkSession.sparkContext.defaultParallelism // parts))
    tests = right.withColumnRenamed("block", "b_block").repartition(max(1, min(n_right, most)))
    trains = left.withColumnRenamed("block", "a_block").repartition(parts)
    pairs = tests.crossJoin(trains.hint("shuffle_replicate_nl"))
    kind = train_docs.schema["label"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids, names, places, dense, last = {}, [], [], {}, {}, (None, None)
        for batch in batches:
            for at in range(batch.num_rows):
                one = {name: column[at] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                a, b = one.pop("a_block").as_py(), one.pop("b_block").as_py()
                one = {name: cell.values for name, cell in one.items()}
                if a not in places:
                    places[a] = sum(map(len, ids))
                    ids.append(one["a_doc_id"].cast("int64"))
                    names.append(one["a_label"])
                if a not in dense:
                    if sum(x.nbytes for x in dense.values()) > KEPT_BYTES:
                        dense.clear()
                    dense[a] = _rows(one, "a", size)
                if last[0] != b:
                    last = b, _rows(one, "b", size)
                if b not in best:
                    best[b] = _Best(one["b_doc_id"].cast("int64"), k)
                best[b].meet(last[1], dense[a], *_folds(one, folded), _ordered(one["a_doc_id"]), places[a], metric, p)
        if best:
            ids, names = pa.chunked_array(ids), pa.chunked_array(names)
            for found in best.values():
                cells = [found.ids.take(pa.array(found.row)), *(x.take(pa.array(found.place)).combine_chunks() for x in (ids, names)), pa.array(found.distance)]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "neighbour", "label", "distance"])

    found = pairs.mapInArrow(search, f"doc_id long, neighbour long, label {kind}, distance double")
    order = Window.partitionBy("doc_id").orderBy("distance", "neighbour")
    ranked = found.withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= k)


def _rows(lists: dict[str, pa.Array], side: str, size: int) -> np.ndarray:
    return _dense(*(lists[f"{side}_{name}"].to_numpy(zero_copy_only=False) for name in ("sizes", "ids", "vals")), size)


def _folds(lists: dict[str, pa.Array], folded: bool) -> tuple:
    return tuple(np.array(lists[f"{side}_fold"].to_pylist()) for side in "ba") if folded else (None, None)


def _ordered(ids: pa.Array) -> np.ndarray:
    """Ids as numbers that order ties, a null first."""
    return ids.cast("int64").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


class _Best:
    """The ``k`` nearest train rows of each row of a test block, of the train blocks met so far."""

    def __init__(self, ids: pa.Array, k: int):
        self.ids, self.k = ids, k
        self.row, self.place, self.order = (np.zeros(0, np.int64) for _ in range(3))
        self.distance, self.limit = np.zeros(0), np.full(len(ids), np.inf)

    def meet(self, test, train, test_fold, train_fold, ids, start, metric, p) -> None:
        """Take in the rows of one train block, whose first place is ``start``."""
        new = []
        for low in range(0, len(test), STRIP):
            some = slice(low, low + STRIP)
            row, near, distance = _near(test[some], train, self.limit[some], self.k, metric, p, None if test_fold is None else test_fold[some], train_fold)
            new.append((row + low, near + start, ids[near], distance))
        row, place, order, distance = (np.concatenate([old, *x]) for old, x in zip((self.row, self.place, self.order, self.distance), zip(*new, strict=True), strict=True))
        by = np.lexsort((order, distance, row))
        row, place, order, distance = row[by], place[by], order[by], distance[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < self.k
        self.row, self.place, self.order, self.distance = row[kept], place[kept], order[kept], distance[kept]
        full = rank[kept] == self.k - 1
        self.limit[self.row[full]] = self.distance[full]


def _near(test, train, limit, k, metric, p, test_fold, train_fold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test row, train row and distance of all that can be among the ``k`` nearest: no farther than the row's limit, or than ``k`` others here."""
    step = max(1, 4_000_000 // max(1, test.shape[1]))

    def exact(row, near):
        if test_fold is not None:
            other = test_fold[row] != train_fold[near]
            row, near = row[other], near[other]
        parts = [_lengths(test[row[at : at + step]] - train[near[at : at + step]], metric, p) for at in range(0, len(row), step)]
        return row, near, np.concatenate(parts) if parts else np.zeros(0)

    if metric == "minkowski" and p > 2 and np.isfinite(limit).all():
        # No such distance is shorter than the euclidean one by more than this factor.
        rough = _rough(test, train, "euclidean", 2.0)
        if rough is not None:
            edge = limit**2 * test.shape[1] ** (1 - 2 / p) * (1 + 1e-9) + rough[1]
            row, near = np.nonzero(rough[0] <= _above(edge, rough[0])[:, None])
            if len(row) <= test.shape[0] * train.shape[0] // 8:
                return exact(*_within(test, train, row, near, limit, p, step))
    # Rough powers choose all rows that can be among the nearest; these are measured in double precision.
    rough = _rough(test, train, metric, p)
    measure, off = rough or (_distances(test, train, metric, p), 0.0)
    power = 1 if rough is None else {"euclidean": 2, "manhattan": 1}.get(metric, p)
    edge = limit**power * (1 + 1e-9) + off
    first = np.flatnonzero(~np.isfinite(edge))
    if len(first):
        # Everything up to the k-th distance, so that ties are settled by id.
        part = measure[first]
        if test_fold is not None:
            part[test_fold[first][:, None] == train_fold[None, :]] = np.inf
        last = min(k, len(train)) - 1
        edge[first] = np.partition(part, last, axis=1)[:, last].astype(float) + 2 * off
        far = first[~np.isfinite(edge[first])]
        if len(far):
            # With fewer than k rows of other folds here, all of them.
            edge[far] = np.finfo(measure.dtype).max
            if test_fold is not None:
                measure[far] = np.where(test_fold[far][:, None] == train_fold[None, :], np.inf, measure[far])
    row, near = np.nonzero(measure <= _above(edge, measure)[:, None])
    return exact(row, near)


def _above(edge: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The edges in the precision of ``like``, none of them lower."""
    with np.errstate(over="ignore"):
        return np.nextafter(edge.astype(like.dtype), like.dtype.type(np.inf))


def _within(test, train, row, near, limit, p, step) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without those that are farther than the row's limit by a rough measure in single precision."""
    if p != int(p) or p > MOST_POWER:
        return row, near
    a, b, power = test.astype(np.float32), train.astype(np.float32), int(p)
    most = float((np.abs(test).max(axis=0, initial=0) ** power).sum() + (np.abs(train).max(axis=0, initial=0) ** power).sum())
    edge = _above(limit**power * (1 + 1e-9) + _off(test.shape[1], power, most), a)
    kept = []
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(row), step // 8 + 1):
            some = slice(at, at + step // 8 + 1)
            diff = np.abs(a[row[some]] - b[near[some]])
            term = diff * diff
            for _ in range(power - 2):
                term *= diff
            kept.append(~(term.sum(axis=1) > edge[row[some]]))
    kept = np.concatenate(kept) if kept else np.zeros(0, bool)
    return row[kept], near[kept]


def _best(lists: dict[str, pa.Array], size: int, k: int, metric: str, p: float, folded: bool) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Test row, train row and distance of each test row's ``k`` nearest in a train block."""
    best = _Best(pa.nulls(len(lists["b_sizes"]), pa.int64()), k)
    best.meet(_rows(lists, "b", size), _rows(lists, "a", size), *_folds(lists, folded), _ordered(lists["a_doc_id"]), 0, metric, p)
    return pa.array(best.row), pa.array(best.place), pa.array(best.distance)


def vote(neighbours: DataFrame, labels: list, weights: str = "uniform") -> DataFrame:
    """``(doc_id, label, prob)``: vote shares by count or by 1 / distance.

    A neighbour at distance 0 outvotes all that are farther away.
    """
    d = F.col("distance")
    if weights == "uniform":
        weighted = neighbours.withColumn("w", F.lit(1.0))
    else:
        zero = F.max((d == 0).cast("int")).over(Window.partitionBy("doc_id"))
        weight = F.when(F.col("_z") == 1, (d == 0).cast("double")).otherwise(1.0 / d)
        weighted = neighbours.withColumn("_z", zero).withColumn("w", weight)
    per = weighted.groupBy("doc_id").agg(
        F.sum("w").alias("_all"), *[F.sum(F.when(F.col("label") == F.lit(v), F.col("w")).otherwise(0.0)).alias(f"_{i}") for i, v in enumerate(labels)]
    )
    cells = F.array(*[F.struct(F.lit(v).alias("label"), (F.col(f"_{i}") / F.col("_all")).alias("prob")) for i, v in enumerate(labels)])
    return per.select("doc_id", F.explode(cells).alias("c")).select("doc_id", "c.label", "c.prob")


def knn(train, train_docs, test, test_docs, size, k=3, weights="uniform", metric="euclidean", p=2.0) -> DataFrame:
    """Vote shares per test document."""
    found = nearest(train, train_docs, test, test_docs, size, k, metric, p)
    return vote(found, label_list(train_docs), weights)

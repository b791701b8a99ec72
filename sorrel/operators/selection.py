"""Feature selection: entropy and correlation scores and the greedy filters.

Inputs are sparse feature tables that are pruned already.  Scores of all
features come from one grouped job; the greedy passes run on the driver over
the short ranked list and the pairs that exceed the limit.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sorrel.functions import stats
from sorrel.operators.ngrams import KEY
from sorrel.operators.weights import label_correlation, label_frequency
from sorrel.plans.staging import assign_position, fits, join_documents, skew_join, small_side, stage

_LOG = {2: F.log2, 10: F.log10, "e": F.log}
# Columns of one block of the pairwise matrix.
BLOCK = 512
# Blocks that one task holds at a time, 2 MB each.
TASK_BLOCKS = 200
# Multiplications of a dense block that take as long as one pair by itself, and pairs taken at a time.
DENSE = 512
CHUNK_PAIRS = 2_000_000
# Pairs that the driver walks by itself.
DRIVER_PAIRS = 1_000_000


# -------------------------------------------------------------------- entropy


def entropy(df: DataFrame, column: str, base=2) -> DataFrame:
    """Entropy of the values of ``column`` as a one-row table."""
    log = _LOG[base]
    counts = df.groupBy(column).agg(F.count("*").cast("double").alias("n"))
    return counts.agg((log(F.sum("n")) - F.sum(F.col("n") * log("n")) / F.sum("n")).alias("entropy"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """``H(x)``, ``H(y)``, ``H(x given y)``, ``I(x; y)`` and SU of two columns in bits."""
    cells = df.groupBy(x, y).agg(F.count("*").alias("n"))
    joint = cells.agg(F.sum("n").alias("n"), F.sum(stats.clog(F.col("n"))).alias("cxy"))
    per = [
        cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(stats.clog(F.col("n"))).alias(f"c{i}"))
        for i, c in enumerate((x, y))
    ]
    n = joint.select("n").scalar()
    h = lambda t, c: F.log2(n) - t.select(c).scalar() / n
    hx, hy, hxy = h(per[0], "c0"), h(per[1], "c1"), h(joint, "cxy")
    mi = hx + hy - hxy
    su = stats.ratio(2 * mi, hx + hy)
    one = joint.select(hx.alias("h_x"), hy.alias("h_y"), (hxy - hy).alias("h_x_given_y"), mi.alias("mi"), su.alias("su"))
    return one


def label_information(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Per feature ``h_x, h_y, h_x_given_y, mi, su`` against the label.

    Values are treated as categories.  Cells of the value zero are the label
    totals minus the rows that exist.
    """
    sizes = stage(label_frequency(labels), "labels")
    side = small_side(sizes)
    rows = join_documents(features, labels.select("doc_id", "label"))
    cells = stage(rows.groupBy(*KEY, "value", "label").agg(F.count("*").alias("n")), "cells")
    by_value = cells.groupBy(*KEY, "value").agg(F.sum("n").alias("nv"), F.sum(stats.clog(F.col("n"))).alias("_c"))
    by_value = by_value.groupBy(*KEY).agg(
        F.sum("nv").alias("nz"), F.sum(stats.clog(F.col("nv"))).alias("c_x"), F.sum("_c").alias("c_xy")
    )
    by_label = cells.groupBy(*KEY, "label").agg(F.sum("n").alias("nl")).join(side.withColumnRenamed("n", "total"), "label")
    rest = stats.clog(F.col("total") - F.col("nl")) - stats.clog(F.col("total"))
    by_label = by_label.groupBy(*KEY).agg(F.sum(rest).alias("c_zero"))
    top = sizes.agg(F.sum("n").alias("n"), F.sum(stats.clog(F.col("n"))).alias("c")).first()
    n, c_y = F.lit(float(top["n"])), F.lit(float(top["c"]))
    joined = by_value.join(by_label, KEY)
    h_x = F.log2(n) - (F.col("c_x") + stats.clog(n - F.col("nz"))) / n
    h_y = F.log2(n) - c_y / n
    h_xy = F.log2(n) - (F.col("c_xy") + c_y + F.col("c_zero")) / n
    out = joined.select(*KEY, F.col("nz").alias("df"), h_x.alias("h_x"), h_y.alias("h_y"), h_xy.alias("h_xy"))
    mi = F.col("h_x") + F.col("h_y") - F.col("h_xy")
    su = stats.ratio(2 * mi, F.col("h_x") + F.col("h_y"))
    return out.select(
        *KEY, "df", "h_x", "h_y", (F.col("h_xy") - F.col("h_y")).alias("h_x_given_y"), mi.alias("mi"), su.alias("su")
    )


def rank_by_su(features: DataFrame, labels: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Features with SU above ``threshold``, best first.

    A negative threshold stands for the smallest SU of any feature.  SU is
    compared and ranked after rounding to 12 digits, so equal features tie.
    """
    info = label_information(features, labels).select(*KEY, "df", stats.rounded(F.col("su"), 12).alias("su"))
    if threshold < 0:
        info = stage(info, "su")
        threshold = info.agg(F.min("su").alias("m")).first()["m"]
    return info.filter(F.col("su") > F.lit(threshold)).orderBy(F.col("su").desc(), *KEY)


# ------------------------------------------------------------- pairs of columns


def _numbered(features: DataFrame, table: DataFrame) -> DataFrame:
    return features.select("doc_id", *KEY, "value").join(small_side(table.select(*KEY, "fid")), KEY)


def _sparse_rows(numbered: DataFrame) -> DataFrame:
    """One row per document with its column numbers and values."""
    pair = F.array_sort(F.collect_list(F.struct("fid", "value")))
    rows = numbered.groupBy("doc_id").agg(pair.alias("p"))
    return rows.select(F.transform("p", lambda x: x["fid"]).alias("ids"), F.transform("p", lambda x: x["value"]).alias("vals"))


def _gram(rows: DataFrame, size: int) -> DataFrame:
    """``(i, j, sxy)`` for ``i <= j``: sums of products over all documents.

    Each task adds the documents of its partition into square blocks of the
    matrix and emits a block once, so the shuffle carries partitions x pairs
    rather than documents x pairs, and a frequent column makes no hot key.
    Documents with few of the columns add only the pairs that they hold.  A
    matrix too large for a task's memory is made in strips of block rows, one
    pass over the documents for each.
    """
    blocks = (size + BLOCK - 1) // BLOCK
    strips, first = [], 0
    while first < blocks:
        last = first + 1
        while last < blocks and (last + 1 - first) * (blocks - first) <= TASK_BLOCKS:
            last += 1
        strips.append((first, last))
        first = last

    def strip(lo: int, hi: int):
        def add(batches):
            total: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                for at in range(0, len(pdf), 1024):
                    _add_products(total, pdf.iloc[at : at + 1024], lo, hi)
            for (a, b), cell in total.items():
                i, j = np.nonzero(cell)
                gi, gj = i + a * BLOCK, j + b * BLOCK
                keep = gi <= gj
                yield pd.DataFrame({"i": gi[keep], "j": gj[keep], "s": cell[i[keep], j[keep]]})

        return rows.mapInPandas(add, "i long, j long, s double")

    parts = reduce(DataFrame.unionByName, [strip(lo, hi) for lo, hi in strips or [(0, 0)]])
    return parts.groupBy("i", "j").agg(F.sum("s").alias("sxy"))


def _add_products(total: dict, pdf: pd.DataFrame, lo: int, hi: int) -> None:
    """Add the products of the documents in ``pdf`` to the blocks in ``total``, pair by pair or as dense blocks."""
    lengths = pdf["ids"].map(len).to_numpy(dtype=np.int64)
    if not lengths.sum():
        return
    pairs = int((lengths * (lengths + 1) // 2).sum())
    blocks = len({int(b) for ids in pdf["ids"] for b in np.unique(np.asarray(ids) // BLOCK)})
    if pairs * DENSE > blocks * (blocks + 1) // 2 * len(pdf) * BLOCK * BLOCK or (pairs > CHUNK_PAIRS and len(pdf) == 1):
        for key, cell in _products(pdf, lo, hi):
            total[key] = total[key] + cell if key in total else cell
    elif pairs > CHUNK_PAIRS:
        for part in (pdf.iloc[: len(pdf) // 2], pdf.iloc[len(pdf) // 2 :]):
            _add_products(total, part, lo, hi)
    else:
        for key, at, cell in _held_pairs(pdf, lengths, lo, hi):
            if key not in total:
                total[key] = np.zeros((BLOCK, BLOCK))
            total[key].reshape(-1)[at] += cell


def _held_pairs(pdf: pd.DataFrame, lengths: np.ndarray, lo: int, hi: int):
    """Sums of products of the column pairs that the documents hold: block, places in it, sums."""
    ids = np.concatenate(pdf["ids"].to_numpy()).astype(np.int64)
    vals = np.concatenate(pdf["vals"].to_numpy()).astype(float)
    row = np.repeat(np.arange(len(pdf)), lengths)
    # Columns ascend in a document; of a repeated one the last counts, as in a dense row.
    keep = np.append((row[1:] != row[:-1]) | (ids[1:] != ids[:-1]), True) & (ids >= lo * BLOCK)
    ids, vals, row = ids[keep], vals[keep], row[keep]
    ends = np.searchsorted(row, row, side="right")
    partners = np.where(ids < hi * BLOCK, ends - np.arange(len(ids)), 0)
    i = np.repeat(np.arange(len(ids)), partners)
    j = i + np.arange(len(i)) - np.repeat(np.cumsum(partners) - partners, partners)
    width = np.int64(1 << 31)
    a, b = ids[i], ids[j]
    where = (a // BLOCK * width + b // BLOCK) * (BLOCK * BLOCK) + a % BLOCK * BLOCK + b % BLOCK
    found, at = np.unique(where, return_inverse=True)
    sums = np.bincount(at, weights=vals[i] * vals[j], minlength=len(found))
    block, cell = np.divmod(found, BLOCK * BLOCK)
    cuts = np.flatnonzero(np.diff(block)) + 1
    for places, part, own in zip(np.split(cell, cuts), np.split(sums, cuts), np.split(block, cuts)):
        if len(own):
            yield (int(own[0] // width), int(own[0] % width)), places, part


def _products(pdf: pd.DataFrame, lo: int, hi: int):
    """Block products of the documents in ``pdf`` for block rows ``lo..hi-1``."""
    lengths = pdf["ids"].map(len).to_numpy()
    if not lengths.sum():
        return
    ids = np.concatenate(pdf["ids"].to_numpy()).astype(np.int64)
    vals = np.concatenate(pdf["vals"].to_numpy()).astype(float)
    row = np.repeat(np.arange(len(pdf)), lengths)
    block = ids // BLOCK
    dense = {}
    for b in np.unique(block[block >= lo]):
        at = block == b
        dense[int(b)] = np.zeros((len(pdf), BLOCK))
        dense[int(b)][row[at], ids[at] % BLOCK] = vals[at]
    for a in dense:
        if a < hi:
            for b in dense:
                if a <= b:
                    yield (a, b), dense[a].T @ dense[b]


def feature_correlation(features: DataFrame, n_docs: int) -> DataFrame:
    """``(ftype_i, feature_i, ftype_j, feature_j, r)`` for pairs ``i < j``.

    Pairs are given in both cases, shared documents or none; r is null where a
    column is constant.
    """
    table = stage(_column_sums(features, n_docs), "columns")
    size = table.count()
    sums = _gram(_sparse_rows(_numbered(features, table)), size)
    return _pair_r(table, sums, size, n_docs)


def _column_sums(features: DataFrame, n_docs: int) -> DataFrame:
    v = F.col("value")
    sums = features.groupBy(*KEY).agg(F.count("*").alias("df"), F.sum(v).alias("sx"), F.sum(v * v).alias("sxx"))
    return assign_position(sums, [F.col(c).asc() for c in KEY], "fid")


def _pair_r(table: DataFrame, sums: DataFrame, size: int, n_docs: int) -> DataFrame:
    left = table.select(F.col("fid").alias("i"), *[F.col(c).alias(f"{c}_i") for c in KEY + ["sx", "sxx"]])
    right = table.select(F.col("fid").alias("j"), *[F.col(c).alias(f"{c}_j") for c in KEY + ["sx", "sxx"]])
    # Every later column, as the matrix itself is the result.
    pairs = left.withColumn("j", F.explode(_later(F.col("i"), size)))
    pairs = pairs.join(small_side(right), "j").join(sums, ["i", "j"], "left")
    n = F.lit(float(n_docs))
    r = stats.pearson(n, F.col("sx_i"), F.col("sx_j"), F.col("sxx_i"), F.col("sxx_j"), F.coalesce("sxy", F.lit(0.0)))
    return pairs.select("ftype_i", "feature_i", "ftype_j", "feature_j", r.alias("r"))


def _ids(table: DataFrame) -> tuple[list, dict]:
    rows = table.collect()
    return rows, {(r["ftype"], r["feature"]): k for k, r in enumerate(rows)}


def pair_su(features: DataFrame, table: DataFrame, n_docs: int) -> DataFrame:
    """SU of all pairs of the numbered features ``table(ftype, feature, fid)``.

    Values are categories; the joint cells of value pairs come from one column
    per (feature, value), and cells with a zero by subtraction.
    """
    own = _numbered(features, table)
    levels = own.groupBy("fid", "value").agg(F.count("*").alias("n"))
    # The lower level number belongs to the lower feature number.
    levels = stage(assign_position(levels, [F.col("fid").asc(), F.col("value").asc()], "lid"), "levels")
    size = levels.count()
    coded = skew_join(own, levels, ["fid", "value"], "n")
    rows = _sparse_rows(coded.select("doc_id", F.col("lid").alias("fid"), F.lit(1.0).alias("value")))
    both = _gram(rows, size).filter("i < j")
    side = small_side(levels)
    a = side.select(F.col("lid").alias("i"), F.col("fid").alias("p"))
    b = side.select(F.col("lid").alias("j"), F.col("fid").alias("q"))
    cells = both.join(a, "i").join(b, "j").filter("p <> q").select("i", "j", "p", "q", F.col("sxy").alias("n"))
    cells = stage(cells.select("i", "j", "p", "q", F.round("n").cast("long").alias("n")), "pairs")
    inner = cells.groupBy("p", "q").agg(F.sum("n").alias("both"), F.sum(stats.clog(F.col("n"))).alias("c"))

    def rest(level, col):
        # Rows with this level of one feature and zero in the other one.
        seen = cells.groupBy("p", "q", level).agg(F.sum("n").alias("m"))
        joined = seen.join(side.select(F.col("lid").alias(level), F.col("n").alias("t")), level)
        diff = stats.clog(F.col("t") - F.col("m")) - stats.clog(F.col("t"))
        return joined.groupBy("p", "q").agg(F.sum(diff).alias(col))

    per = levels.groupBy("fid").agg(F.sum("n").alias("nz"), F.sum(stats.clog(F.col("n"))).alias("cx"))
    n = F.lit(float(n_docs))
    per = stage(per.withColumn("h", F.log2(n) - (F.col("cx") + stats.clog(n - F.col("nz"))) / n), "single")
    left = per.select(F.col("fid").alias("p"), *[F.col(c).alias(c + "_p") for c in ("nz", "cx", "h")])
    right = per.select(F.col("fid").alias("q"), *[F.col(c).alias(c + "_q") for c in ("nz", "cx", "h")])
    # Features that never meet share information too, so every later one counts.
    every = left.withColumn("q", F.explode(_later(F.col("p"), table.count())))
    joined = every.join(small_side(right), "q")
    for part in (inner, rest("i", "rp"), rest("j", "rq")):
        joined = joined.join(part, ["p", "q"], "left")
    joined = joined.fillna(0).select("*", (n - F.col("nz_p") - F.col("nz_q") + F.col("both")).alias("none"))
    c_xy = F.col("c") + F.col("cx_p") + F.col("rp") + F.col("cx_q") + F.col("rq") + stats.clog(F.col("none"))
    mi = F.col("h_p") + F.col("h_q") - (F.log2(n) - c_xy / n)
    return joined.select("p", "q", stats.ratio(2 * mi, F.col("h_p") + F.col("h_q")).alias("su"))


def _later(number, size: int):
    return F.when(number < size - 1, F.sequence(number + 1, F.lit(size - 1).cast("long")))


# ------------------------------------------------------------------ the filters


def _greedy(pairs: DataFrame, size: int) -> list[int]:
    """Numbers that survive when each kept one drops all ``worse`` of its pairs.

    A short pair list is walked on the driver.  A long one stays in Spark and is
    settled in rounds: a number is kept once no better one is open, and dropped
    once a better one is kept; the driver holds one state per feature.
    """
    pairs = stage(pairs, "hits")
    if fits(pairs, DRIVER_PAIRS):
        drops = defaultdict(list)
        for r in pairs.collect():
            drops[r["better"]].append(r["worse"])
        gone: set[int] = set()
        for k in range(size):
            if k not in gone:
                gone.update(drops.get(k, ()))
        return [k for k in range(size) if k not in gone]
    kept: set[int] = set()
    open_ = set(range(size))
    while open_:
        ids = pairs.sparkSession.createDataFrame([(k,) for k in open_], "id long")
        still = F.broadcast(ids)
        live = pairs.join(still.withColumnRenamed("id", "better"), "better").join(still.withColumnRenamed("id", "worse"), "worse")
        live = stage(live.select("better", "worse"), "live")
        waiting = {r["worse"] for r in live.select("worse").distinct().collect()}
        new = open_ - waiting
        kept |= new
        best = pairs.sparkSession.createDataFrame([(k,) for k in new], "better long")
        gone = {r["worse"] for r in live.join(F.broadcast(best), "better").select("worse").distinct().collect()}
        open_ -= new | gone
        pairs = live
    return sorted(kept)


def fcbf(features: DataFrame, labels: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Fast correlation-based filter (Yu & Liu 2003): ``(ftype, feature, weight, rank)``.

    A feature falls when a better one that is kept has at least as much SU with
    it as the label has.
    """
    features = stage(join_documents(features, labels.select("doc_id"), "left_semi"), "fcbf")
    ranked, place = _ids(rank_by_su(features, labels, threshold))
    spark = features.sparkSession
    names = [(t, f, k) for (t, f), k in place.items()]
    kept = list(range(len(ranked)))
    if len(ranked) > 1:
        n_docs = labels.count()
        table = spark.createDataFrame(names, "ftype string, feature string, fid long")
        su = {r["fid"]: r["su"] for r in (dict(fid=k, su=row["su"]) for k, row in enumerate(ranked))}
        scores = stats.rounded(F.col("su"), 12)
        weight = spark.createDataFrame([(k, float(v)) for k, v in su.items()], "worse long, bar double")
        pairs = pair_su(features, table, n_docs).select(
            F.least("p", "q").alias("better"), F.greatest("p", "q").alias("worse"), scores.alias("su")
        )
        hits = pairs.join(F.broadcast(weight), "worse").filter(F.col("su") >= F.col("bar"))
        kept = _greedy(hits.select("better", "worse"), len(ranked))
    rows = [(ranked[k]["ftype"], ranked[k]["feature"], float(ranked[k]["su"]), i) for i, k in enumerate(kept)]
    return spark.createDataFrame(rows, "ftype string, feature string, weight double, rank int")


def pearson_relevance(features: DataFrame, numeric: DataFrame) -> DataFrame:
    """Strength of each feature: absolute r with the label, 0.0 where undefined."""
    out = label_correlation(features, numeric, with_p=False)
    return out.select(*KEY, F.coalesce(F.abs("r"), F.lit(0.0)).alias("strength"))


def selection_weights(features: DataFrame, numeric: DataFrame) -> DataFrame:
    """Strength of each feature followed by its correlations, one row per pair."""
    features = stage(join_documents(features, numeric.select("doc_id"), "left_semi"), "mrmr")
    pairs = feature_correlation(features, numeric.count())
    r = F.coalesce(F.abs("r"), F.lit(0.0)).alias("r")
    flip = pairs.select(
        F.col("ftype_j").alias("ftype_i"), F.col("feature_j").alias("feature_i"),
        F.col("ftype_i").alias("ftype_j"), F.col("feature_i").alias("feature_j"), r,
    )
    both = pairs.withColumn("r", r).unionByName(flip)
    strength = pearson_relevance(features, numeric).select(
        F.col("ftype").alias("ftype_i"), F.col("feature").alias("feature_i"), "strength"
    )
    return both.join(F.broadcast(strength), ["ftype_i", "feature_i"])


def mrmr_linear(features: DataFrame, numeric: DataFrame, threshold: str) -> DataFrame:
    """Greedy relevance / redundancy filter: ``(ftype, feature, weight, rank)``.

    ``threshold`` is ``strength_correlation``; a strength above 1 is a number
    of features to keep.
    """
    strong, limit = (float(part) for part in threshold.split("_"))
    if "label_num" not in numeric.columns:
        numeric = numeric.withColumn("label_num", F.col("label").cast("double"))
    features = stage(join_documents(features, numeric.select("doc_id"), "left_semi"), "mrmr")
    spark = features.sparkSession
    relevance = pearson_relevance(features, numeric).withColumn("strength", stats.rounded(F.col("strength"), 12))
    ranked, place = _ids(relevance.orderBy(F.col("strength").desc(), *KEY))
    pairs = feature_correlation(features, numeric.count()).filter(F.abs("r") > limit)
    names = spark.createDataFrame([(t, f, k) for (t, f), k in place.items()], "ftype string, feature string, fid long")
    for side in ("i", "j"):
        named = names.select(F.col("ftype").alias(f"ftype_{side}"), F.col("feature").alias(f"feature_{side}"), F.col("fid").alias(side))
        pairs = pairs.join(F.broadcast(named), [f"ftype_{side}", f"feature_{side}"])
    near = pairs.select(F.least("i", "j").alias("better"), F.greatest("i", "j").alias("worse"))
    kept = []
    for k in _greedy(near, len(ranked)):
        # The first feature that falls short ends the walk.
        if len(kept) >= strong if strong > 1 else ranked[k]["strength"] <= strong:
            break
        kept.append(k)
    rows = [(ranked[k]["ftype"], ranked[k]["feature"], float(ranked[k]["strength"]), i) for i, k in enumerate(kept)]
    return spark.createDataFrame(rows, "ftype string, feature string, weight double, rank int")

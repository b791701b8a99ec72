"""Weights, scaling, balance and selection."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import NaiveBayes as MLBayes
from pyspark.ml.feature import IDF
from pyspark.sql import functions as F

from sorrel.operators import balance as bal, instances, naive_bayes as nb, scaling, selection as fs, weights
from sorrel.plans import staging


def features(spark, cells):
    rows = [(d, "t", f, float(v)) for d, f, v in cells]
    return spark.createDataFrame(rows, "doc_id long, ftype string, feature string, value double")


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, label string")


def random_case(spark, seed, n_docs=40, n_features=8, top=3):
    rng = random.Random(seed)
    cells = [(d, f"f{f}", rng.randint(1, top)) for d in range(n_docs) for f in range(n_features) if rng.random() < 0.2 + 0.08 * f]
    classes = [rng.choice("ab") for _ in range(n_docs)]
    # Two features that follow the class, one a copy of the other.
    cells += [(d, g, 1) for d, c in enumerate(classes) if (c == "a") != (rng.random() < 0.1) for g in ("good", "twin")]
    return cells, classes, features(spark, cells), labels(spark, classes)


def columns(cells, n):
    out = {}
    for d, f, v in cells:
        out.setdefault(f, [0] * n)[d] = v
    return out


def H(values):
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in Counter(values).values())


def su(x, y):
    hx, hy, hxy = H(x), H(y), H(list(zip(x, y)))
    return 0.0 if hx + hy == 0 else round(2 * (hx + hy - hxy) / (hx + hy), 12)


def pearson(x, y):
    n, mx, my = len(x), sum(x) / len(x), sum(y) / len(y)
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    d = math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    return 0.0 if d == 0 else sxy / d


def test_symmetrical_uncertainty_of_extremes(spark):
    f = features(spark, [(0, "same", 1), (1, "same", 1), *[(d, "flat", 1) for d in range(4)]])
    got = {r["feature"]: r["su"] for r in fs.label_information(f, labels(spark, "aabb")).collect()}
    assert got["same"] == pytest.approx(1.0) and got["flat"] == pytest.approx(0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_su_and_fcbf_against_brute_force(spark, seed):
    cells, classes, f, l = random_case(spark, seed)
    cols = columns(cells, len(classes))
    want = {k: su(v, classes) for k, v in cols.items()}
    got = {r["feature"]: r["su"] for r in fs.rank_by_su(f, l, -5).collect()}
    low = min(want.values())
    assert got == pytest.approx({k: v for k, v in want.items() if v > low}, abs=1e-9)
    order = sorted((k for k in want if want[k] > 0.001), key=lambda k: (-want[k], k))
    kept = []
    gone = set()
    for i, p in enumerate(order):
        if p not in gone:
            kept.append(p)
            gone.update(q for q in order[i + 1 :] if su(cols[p], cols[q]) >= want[q])
    assert [r["feature"] for r in fs.fcbf(f, l, 0.001).orderBy("rank").collect()] == kept
    assert ("good" in kept) != ("twin" in kept)


def test_fcbf_with_a_threshold_above_everything_is_empty(spark):
    _, _, f, l = random_case(spark, 3)
    assert fs.fcbf(f, l, 0.99).count() == 0


@pytest.mark.parametrize("threshold", ["0.05_0.5", "3_0.9"])
def test_mrmr_against_brute_force(spark, threshold):
    cells, classes, f, _ = random_case(spark, 4)
    y = [float(c == "a") for c in classes]
    numeric = spark.createDataFrame(list(enumerate(y)), "doc_id long, label_num double")
    cols = columns(cells, len(classes))
    strength = {k: round(abs(pearson(v, y)), 12) for k, v in cols.items()}
    s, limit = (float(t) for t in threshold.split("_"))
    kept, gone = [], set()
    for k in sorted(strength, key=lambda k: (-strength[k], k)):
        if k in gone:
            continue
        if (len(kept) >= s) if s > 1 else strength[k] <= s:
            break
        kept.append(k)
        gone.update(q for q in cols if q != k and abs(pearson(cols[k], cols[q])) > limit)
    assert [r["feature"] for r in fs.mrmr_linear(f, numeric, threshold).orderBy("rank").collect()] == kept


def test_long_pair_lists_are_settled_in_rounds(spark, monkeypatch):
    rng = random.Random(11)
    pairs = [(a, b) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.1]
    table = spark.createDataFrame(pairs, "better long, worse long")
    walked = fs._greedy(table, 30)
    monkeypatch.setattr(fs, "DRIVER_PAIRS", 1)
    assert fs._greedy(table, 30) == walked


def test_correlation_matrix_in_strips(spark, monkeypatch):
    cells, classes, f, _ = random_case(spark, 5)
    whole = {tuple(r)[:4]: r["r"] for r in fs.feature_correlation(f, len(classes)).collect()}
    monkeypatch.setattr(fs, "BLOCK", 2)
    monkeypatch.setattr(fs, "TASK_BLOCKS", 6)
    parts = {tuple(r)[:4]: r["r"] for r in fs.feature_correlation(f, len(classes)).collect()}
    assert parts == pytest.approx(whole)
    cols = columns(cells, len(classes))
    for (_, a, _, b), r in whole.items():
        assert r == pytest.approx(pearson(cols[a], cols[b]), abs=1e-9)


def test_p_value_of_a_correlation(spark):
    # r = 0.6 over 10 rows: t = 2.1213 with 8 degrees of freedom.
    from sorrel.functions.stats import pearson_p

    row = spark.createDataFrame([(0.6, 10.0), (0.0, 10.0), (1.0, 10.0)], "r double, n double")
    got = [r["p"] for r in row.select(pearson_p("r", "n").alias("p")).collect()]
    assert got == pytest.approx([0.066688, 1.0, 0.0], abs=1e-5)


def test_balance_two_and_three_labels(spark):
    two = bal.balance(labels(spark, "aaaaaabb")).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in two} == {"a": 4, "b": 4}
    three = bal.balance(labels(spark, "a" * 9 + "b" * 4 + "c"))
    assert {r["label"]: r["count"] for r in three.groupBy("label").count().collect()} == {"a": 4, "b": 4, "c": 4}
    assert sorted(r["copy"] for r in three.filter("label = 'c'").collect()) == [0, 1, 2, 3]


def test_balance_makes_many_copies_in_chunks(spark, monkeypatch):
    l = labels(spark, "a" * 30 + "b" * 20 + "c")
    want = sorted(tuple(r) for r in bal.balance(l).collect())
    monkeypatch.setattr(bal, "CHUNK", 3)
    assert sorted(tuple(r) for r in bal.balance(l).collect()) == want


def test_scaling_writes_moved_zeros(spark):
    f = features(spark, [(0, "x", 2), (1, "x", 4), (0, "y", -1)])
    docs = spark.createDataFrame([(0,), (1,), (2,)], "doc_id long")
    got = {(r["doc_id"], r["feature"]): r["value"] for r in scaling.apply_minmax(f, scaling.fit_minmax(f, 3), docs, 1, 2).collect()}
    assert got == {(0, "x"): 1.5, (1, "x"): 2.0, (2, "x"): 1.0, (0, "y"): 1.0, (1, "y"): 2.0, (2, "y"): 2.0}


def test_tfidf_rows_have_norm_one_and_align_keeps_own_columns(spark):
    _, _, f, l = random_case(spark, 6)
    fitted = weights.fit_vectorizer(f, l, "tfidf", None)
    rows = weights.apply_vectorizer(fitted, f)
    norms = rows.groupBy("doc_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0) for r in norms)
    assert weights.align(f, fitted.selection).select(f.columns).exceptAll(f).count() == 0


def test_smooth_idf_is_the_library_value_plus_one(spark):
    _, classes, f, l = random_case(spark, 7)
    n = len(classes)
    top = staging.stage(weights.prune_top_k(f, 100))
    vectors = instances.sparse_instances(weights.select_features(f, top), l, top.count())
    model = IDF(inputCol="features", outputCol="o").fit(vectors)
    ids = {r["feature"]: r["feature_id"] for r in top.collect()}
    for r in weights.idf_smooth(f, n).collect():
        assert r["idf"] == pytest.approx(model.idf[ids[r["feature"]]] + 1)


def test_bayes_log_probabilities_match_the_library(spark):
    _, _, f, l = random_case(spark, 8)
    top = staging.stage(weights.prune_top_k(f, 100))
    coded = instances.label_index(l).withColumn("code", F.col("code").cast("double"))
    vectors = instances.sparse_instances(weights.select_features(f, top), coded, top.count())
    theta = MLBayes(labelCol="code", smoothing=1.0).fit(vectors).theta.toArray()
    ids = {r["feature"]: r["feature_id"] for r in top.collect()}
    for r in nb.feature_log_prob(nb.fit_naive_bayes(f, l)).collect():
        assert r["log_prob"] == pytest.approx(theta["ab".index(r["label"])][ids[r["feature"]]], abs=1e-12)


def test_many_labels_take_the_long_form(spark, monkeypatch):
    _, _, f, l = random_case(spark, 9)
    wide = {tuple(r)[:2]: r["prob"] for r in nb.fit_naive_bayes(f, l).scores(f, l).collect()}
    monkeypatch.setattr(nb, "WIDE_LABELS", 1)
    long = {tuple(r)[:2]: r["prob"] for r in nb.fit_naive_bayes(f, l).scores(f, l).collect()}
    assert long == pytest.approx(wide)


def test_split_join_agrees_with_a_plain_join(spark):
    rows = [(i, "t", "hot" if i % 3 == 0 else f"f{i % 7}", 1.0) for i in range(300)]
    big = spark.createDataFrame(rows, "doc_id long, ftype string, feature string, value double")
    table = staging.stage(big.groupBy("ftype", "feature").agg(F.count("*").alias("df")).filter("feature <> 'f2'"))
    for how in ("inner", "left_semi"):
        plain = big.join(table, ["ftype", "feature"], how).orderBy("doc_id").collect()
        split = staging.skew_join(big, table, ["ftype", "feature"], how=how, broadcast_rows=1, hot_keys=4)
        assert split.orderBy("doc_id").select(plain[0].__fields__).collect() == plain


def test_positions_do_not_depend_on_partitions(spark):
    rows = [(i * 37 % 101,) for i in range(101)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k long").repartition(parts)
        got = staging.assign_position(df, [F.col("k").desc()]).collect()
        assert all(r["pos"] == 100 - r["k"] for r in got)


def test_sparse_instances_fill_empty_documents(spark):
    f = features(spark, [(0, "x", 2)]).withColumn("feature_id", F.lit(1))
    rows = instances.sparse_instances(f, labels(spark, "ab"), 3).orderBy("doc_id").collect()
    assert [list(r["features"].toArray()) for r in rows] == [[0, 2, 0], [0, 0, 0]]


def test_all_pairs_stay_in_the_range_of_su(spark):
    _, classes, f, l = random_case(spark, 10)
    names = sorted({r["feature"] for r in f.collect()})
    table = spark.createDataFrame([("t", n, i) for i, n in enumerate(names)], "ftype string, feature string, fid long")
    got = fs.pair_su(f, table, len(classes)).collect()
    assert len(got) == len(list(itertools.combinations(names, 2))) and all(-1e-9 <= r["su"] <= 1 + 1e-9 for r in got)


def test_broadcasts_are_bound_by_bytes(spark):
    few = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array_repeat(F.lit(1.0), 100).alias("v"))
    assert staging.fits(few) and not staging.fits(few, rows=9) and not staging.fits(few, size=10_000)
    staged = staging.stage(few)
    assert staging.fits(staged) and not staging.fits(staged, size=10_000) and staging.fits(staged, size=30_000)


def test_pairs_of_few_columns_are_added_without_dense_blocks(monkeypatch):
    rng = random.Random(3)
    rows = [sorted(rng.sample(range(3000), rng.randint(0, 40))) for _ in range(200)]
    rows[5] = [7, 7, 9]
    pdf = pd.DataFrame({"ids": [np.array(r, dtype=np.int64) for r in rows], "vals": [np.array([float(i % 5) for i in r]) for r in rows]})
    dense = {}
    for key, cell in fs._products(pdf, 1, 4):
        dense[key] = np.triu(cell) if key[0] == key[1] else cell
    monkeypatch.setattr(fs, "_products", lambda *args: pytest.fail("dense blocks"))
    monkeypatch.setattr(fs, "CHUNK_PAIRS", 5000)
    found = {}
    fs._add_products(found, pdf, 1, 4)
    assert found.keys() <= dense.keys()
    for key, cell in dense.items():
        assert np.array_equal(found.get(key, np.zeros_like(cell)), cell)

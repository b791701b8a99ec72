import numpy as np
import pytest

from sorrel.operators import boosting, learners
from sorrel.sources import storage


def brute(x, y, depth, lr, lam, alpha, least, gamma, rounds):
    """Probabilities of a plain booster; absent values are nan."""
    margin = np.zeros(len(y))

    def worth(g, h):
        return max(abs(g) - alpha, 0) ** 2 / (h + lam)

    def leaf(g, h):
        return -np.sign(g) * max(abs(g) - alpha, 0) / (h + lam) * lr

    def grow(rows, g, h, left_depth, out):
        whole = (g[rows].sum(), h[rows].sum())
        best = None
        if left_depth:
            for f in range(x.shape[1]):
                v = x[rows, f]
                for b, cut in enumerate(np.unique(v[~np.isnan(v)])):
                    for absent_left in (True, False):
                        side = np.where(np.isnan(v), absent_left, v < cut)
                        gl, hl = g[rows][side].sum(), h[rows][side].sum()
                        gr, hr = whole[0] - gl, whole[1] - hl
                        if min(hl, hr) < max(least, 1e-12):
                            continue
                        gain = round(worth(gl, hl) + worth(gr, hr) - worth(*whole), 9)
                        if best is None or gain > best[0]:
                            best = (gain, side)
        if best is None or best[0] <= boosting.LEAST_GAIN or best[0] < gamma:
            out[rows] += leaf(*whole)
            return
        grow(rows[best[1]], g, h, left_depth - 1, out)
        grow(rows[~best[1]], g, h, left_depth - 1, out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), p - y, p * (1 - p), depth, step)
        margin += step
    return 1 / (1 + np.exp(-margin))


def tables(spark, x, labels):
    cells = [(d, f, float(x[d, f])) for d, f in zip(*np.nonzero(~np.isnan(x)), strict=True)]
    vectors = spark.createDataFrame([(int(d), int(f), v) for d, f, v in cells], "doc_id long, feature_id int, value double")
    return vectors, spark.createDataFrame(list(enumerate(labels)), "doc_id long, label string")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.integers(1, 6, (80, 7)).astype(float) + rng.integers(0, 2, (80, 7)) * 0.25
    x[rng.random(x.shape) < 0.5] = np.nan
    y = (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]) * (np.nan_to_num(x[:, 2]) > 2) + rng.normal(size=80) > 4).astype(int)
    return x, y


@pytest.mark.parametrize(("depth", "lam", "alpha", "least", "gamma", "rounds"), [(3, 1.0, 0.0, 1.0, 0.0, 4), (2, 0.3, 0.4, 2.0, 0.5, 3), (4, 1.0, 0.0, 0.0, 0.0, 2)])
@pytest.mark.parametrize("driver_cells", [boosting.DRIVER_CELLS, 0])
def test_leaves_against_a_plain_booster(spark, data, monkeypatch, driver_cells, depth, lam, alpha, least, gamma, rounds):
    monkeypatch.setattr(boosting, "DRIVER_CELLS", driver_cells)
    x, y = data
    vectors, labels = tables(spark, x, ["no" if v == 0 else "yes" for v in y])
    model = boosting.fit_boosted(vectors, labels, 7, 0.3, least, depth, gamma, n_estimators=rounds, reg_lambda=lam, reg_alpha=alpha)
    got = {r["doc_id"]: r["prob"] for r in model.scores(vectors, labels).filter("label = 'yes'").collect()}
    want = brute(x, y, depth, 0.3, lam, alpha, least, gamma, rounds)
    assert [got[i] for i in range(len(y))] == pytest.approx(want.tolist(), abs=1e-9)
    assert sum(model.importance().values()) == pytest.approx(1.0)


def test_many_trees_over_written_sums_and_labels(spark, data, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    x, y = data
    names = ["c" if v and i % 2 else "b" if v else "a" for i, v in enumerate(y)]
    vectors, labels = tables(spark, x, names)
    model = boosting.fit_boosted(vectors, labels, 7, 0.3, max_depth=2, n_estimators=5)
    scores = model.scores(vectors, labels).collect()
    for name in "abc":
        single = np.array([brute(x, np.array([n == m for n in names]).astype(int), 2, 0.3, 1.0, 0.0, 1.0, 0.0, 5) for m in "abc"])
        got = {r["doc_id"]: r["prob"] for r in scores if r["label"] == name}
        want = single["abc".index(name)] / single.sum(axis=0)
        assert [got[i] for i in range(len(y))] == pytest.approx(want.tolist(), abs=1e-9)


def test_draws_weights_and_storage(spark, data, tmp_path):
    x, y = data
    vectors, labels = tables(spark, x, [str(v) for v in y])
    plain = boosting.fit_boosted(vectors, labels, 7, n_estimators=3, max_depth=2)
    drawn = boosting.fit_boosted(vectors, labels, 7, n_estimators=3, max_depth=2, subsample=0.5, colsample_bytree=0.4, scale_pos_weight=5)
    again = boosting.fit_boosted(vectors.repartition(3), labels.repartition(2), 7, n_estimators=3, max_depth=2, subsample=0.5, colsample_bytree=0.4, scale_pos_weight=5)
    assert all(len({c for c in t.column if c >= 0}) <= 3 for trees in drawn.rounds for t in trees)
    assert [t.column for r in drawn.rounds for t in r] == [t.column for r in again.rounds for t in r]
    share = lambda m: m.scores(vectors, labels).filter("label = '1'").agg({"prob": "avg"}).first()[0]
    assert share(drawn) > share(plain)
    storage.save_model(plain, str(tmp_path / "m"), spark)
    loaded = storage.load_model(str(tmp_path / "m"), spark)
    assert sorted(loaded.scores(vectors, labels).collect()) == sorted(plain.scores(vectors, labels).collect())
    named = spark.createDataFrame([(i, "tokens", f"w{i}") for i in range(7)], "feature_id int, ftype string, feature string")
    assert learners.feature_importance(loaded, named).count() == len(plain.importance())


def test_no_columns_and_one_label(spark):
    vectors, labels = tables(spark, np.full((4, 2), np.nan), ["a", "b", "b", "b"])
    got = {(r["doc_id"], r["label"]): r["prob"] for r in boosting.fit_boosted(vectors, labels, 2, n_estimators=30).scores(vectors, labels).collect()}
    assert len(got) == 8 and got[0, "b"] > 0.5
    only = labels.withColumn("label", labels.label.substr(9, 1))
    assert {r["prob"] for r in boosting.fit_boosted(vectors, only, 2, n_estimators=2).scores(vectors, only).collect()} == {1.0}

import math
from collections import defaultdict

import numpy as np
import pytest

from sorrel.llm import ann
from sorrel.llm.queries import QUERIES
from tests_llm_common import SF, rows


def brute(vectors, queries, k):
    """``{query: [(id, score)]}`` by all inner products."""
    good = {(i, tuple(v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if q in queries:
            hits = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in hits[:k]]
    return out


def search(spark, vectors, queries, k=5, **more):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = df.filter(df.vec_id.isin(list(queries)))
    got = defaultdict(dict)
    for r in rows(ann.search(df, asked, k=k, **more)):
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    return {q: [x[n] for n in sorted(x)] for q, x in got.items()}


def test_graph_is_flat_and_whole():
    v = np.random.default_rng(1).normal(size=(900, 8)).astype(np.float32)
    layers = ann.build_graph(np.arange(900), v)
    assert len(layers) >= 2 and len(layers[0][0]) == 900
    nodes, links = layers[0]
    assert links.shape == (900, 2 * ann.LINKS) and (links < 900).all()
    seen, todo = {0}, [0]
    while todo:
        for n in links[todo.pop()]:
            if n >= 0 and n not in seen:
                seen.add(int(n))
                todo.append(int(n))
    assert len(seen) == 900


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    v = (centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))) * rng.uniform(0.5, 2, (3000, 1))
    vectors = [(n, [float(np.float32(x)) for x in row]) for n, row in enumerate(v)]
    queries = set(range(0, 3000, 50))
    got = search(spark, vectors, queries, k=20, shard_rows=700)
    want = brute(vectors, queries, 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95
    scores = {q: dict(brute([vectors[q], *(vectors[i] for i, _ in got[q])], {q}, 20)[q]) for q in list(queries)[:10]}
    assert all(abs(s - scores[q][i]) < 1e-12 for q in scores for i, s in got[q])


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(n, [1.0, 0.0]) for n in range(100, 160)] + [(n, [0.0, 1.0]) for n in range(8)] + [
        (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [-0.0, 1.0]), (20, None), (21, []), (22, [0.0, 0.0]), (23, [nan, 1.0]), (24, [inf, 1.0]),
        (25, [None, 1.0]), (None, [1.0, 1.0]), (30, [1.0, 1.0, 1.0]), (31, [2.0, 0.0, 0.0]), (40, [-1.0, -1.0]),
    ]
    queries = {0, 8, 20, 22, 23, 30, 40, 100, 159}
    got, want = search(spark, vectors, queries), brute(vectors, queries, 5)
    assert got == want and got[159][0][0] == 100 and [i for i, _ in got[100]] == [101, 102, 103, 104, 105]


@pytest.mark.parametrize("block", [4096, 3])
def test_few_and_no_candidates(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    monkeypatch.setattr(ann, "WALKS", 2)
    vectors = [(n, [float(n + 1), 1.0]) for n in range(9)]
    assert search(spark, vectors, set(range(9)), k=20) == brute(vectors, set(range(9)), 20)
    assert search(spark, vectors[:1], {0}) == {}
    assert search(spark, [(1, None)], {1}) == {}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, rank int, score int, shard int")
    assert ann.search(empty, empty).count() == 0


def test_query_recall(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(vectors, {i for i, _ in vectors if i % 20 == 0}, 20)
    got = defaultdict(list)
    for r in sorted(rows(QUERIES["op7_nearest_neighbours"](spark, SF)), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def recall(v, q, ef=ann.EF, k=20):
    """Share of the ``k`` largest inner products that a walk of one shard finds."""
    v = v.astype(np.float32)
    layers, exact, found = ann.build_graph(np.arange(len(v)), v), v[:q].astype(float) @ v.T.astype(float), []
    for n, beam in enumerate(ann.walk(v, layers, v[:q], ef)):
        best = np.argsort(-exact[n], kind="stable")[:k]
        found.append(len(set(best.tolist()) & set(beam.tolist())) / k)
    return np.mean(found)


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_recall_on_vectors_of_unequal_length(spread):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(8192, 64)) * rng.lognormal(sigma=spread, size=(8192, 1))
    assert recall(v, 128) >= 0.95


def test_recall_with_near_lists_of_random_partitions(monkeypatch):
    monkeypatch.setattr(ann, "EXACT", 2000)
    rng = np.random.default_rng(4)
    assert recall(rng.normal(size=(20_000, 32)) * rng.uniform(0.5, 2, (20_000, 1)), 128) >= 0.95


def test_equal_scores_of_unlike_vectors_go_by_id(spark):
    rng = np.random.default_rng(5)
    vectors = [(n, [float(x) for x in row]) for n, row in enumerate(rng.integers(-2, 3, (400, 6)))]
    queries = set(range(0, 400, 25))
    got, want = search(spark, vectors, queries, k=20), brute(vectors, queries, 20)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95
    # Of the beam's nodes the smallest ids of a score come first.
    assert all(x == sorted(x, key=lambda r: (-r[1], r[0])) for x in got.values())


def test_an_id_with_several_vectors_asks_once(spark):
    vectors = [(1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    for order in (vectors, vectors[::-1]):
        assert search(spark, order, {1}) == {1: [(2, 3.0), (3, 3.0), (2, 0.0)]}

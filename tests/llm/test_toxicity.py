import numpy as np
from pyspark.sql import functions as F

from sorrel.llm import toxicity
from sorrel.llm.queries import QUERIES
from tests_llm_common import rows


def chain():
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def test_held_out_accuracy(spark):
    """A sample of some 2,000 rows: the forms that it lacks go unseen, clean texts are left alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    truth = test.select("doc_id", F.col("toxic").alias("t"), (1 - F.col("quality")).alias("q"))
    got = toxicity.toxicity(docs, train, chain()).join(truth, "doc_id").toPandas()
    for said, told in ((got.toxic, got.t == 1), (got.low_quality, got.q == 1)):
        assert (said & told).sum() >= 0.75 * told.sum() and (said & ~told).sum() <= 0.005 * (~told).sum()


def test_limits_part_the_classes():
    p = np.array([0.9, 0.8, 0.3, 0.3, 0.1])
    assert toxicity.best_limit(p, np.array([1, 1, 0, 0, 0])) == (0.8 + 0.3) / 2
    assert toxicity.best_limit(p, np.array([1, 1, 1, 1, 0])) == (0.3 + 0.1) / 2
    assert toxicity.best_limit(p, np.zeros(5)) == 0.5 == toxicity.best_limit(p, np.ones(5))


def test_later_models_read_earlier_probabilities():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, (600, 1))
    texts = [f"{'bad' if a else 'good'}word {' '.join(rng.choice(list('abcdefgh'), 8))} {n}" for n, (a,) in enumerate(y)]
    made = toxicity.fit_chain(texts, np.hstack((y, y)), ("first", "second"))
    assert made.models[1].middle.shape[0] == made.models[0].middle.shape[0] + 1
    assert made.models[1].weights[len(made.models[1].chosen) + made.models[1].middle.shape[0] - 1] > 0
    p = toxicity.predict([f"{w} a b c d e f g h 123" for w in ("badword", "goodword", "badwords")], made, {})
    assert p[0, 1] > 0.5 > p[1, 1] and p[2, 1] > 0.5


def test_words_are_forgotten_without_loss(monkeypatch):
    texts = [f"{'bad' if n % 2 else 'good'} w{n % 7}" for n in range(200)]
    made = toxicity.fit_chain(texts, np.array([[n % 2] for n in range(200)]), ("x",))
    want = toxicity.predict(texts, made, {})
    monkeypatch.setattr(toxicity, "WORDS", 2)
    assert (toxicity.predict(texts, made, {}) == want).all()


def test_long_texts_do_not_shrink_the_sample(spark):
    texts = [(n, f"{'bad' if n % 2 else 'good'}word " * (40 if n < 60 else 4) + str(n)) for n in range(100)] + [(100, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(n, 1, n % 2) for n, _ in texts], "doc_id long, quality int, toxic int")
    held, told = toxicity.sample(docs, labels, chain(), "doc_id", "text", 40, 100)
    assert sorted(held) == sorted(t for n, t in texts if 60 <= n < 100) and told.shape == (40, 2)
    held, _ = toxicity.sample(docs, labels, chain(), "doc_id", "text", 60, 100)
    assert len(held) == 60 and max(map(len, held)) <= 100
    got = rows(toxicity.toxicity(docs, labels, chain(), row_chars=20))
    assert all(r["toxic"] == bool(r["doc_id"] % 2) for r in got if r["doc_id"] < 100)


def test_odd_rows(spark, odd, no_documents):
    schema = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "x"), (2, 0, 0, "x"), (7, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (8, 1, None, "x")], schema)
    got = rows(toxicity.toxicity(odd, labels, chain()))
    assert len(got) == odd.count() and all(0 <= r["p_toxic"] <= 1 for r in got)
    assert toxicity.toxicity(no_documents, labels, chain()).count() == 0
    none = rows(toxicity.toxicity(odd, labels.limit(0), chain()))
    assert len(none) == odd.count() and all(r["p_toxic"] < 1e-6 for r in none)
    assert not any(r["toxic"] for r in none)
    one = rows(toxicity.toxicity(odd, labels.filter("toxic = 1 and quality = 0"), chain()))
    assert all(r["p_toxic"] > 0.99 for r in one)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(QUERIES["op8_toxicity"](spark, sf))
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]]) for r in got if r["doc_id"] in truth]) > 0.93

"""The pipeline's stages against plain Python on the smallest tables."""

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from sorrel.llm import decontaminate, language, secrets, tokens
from sorrel.llm.queries import vocabulary
from test_decontaminate import brute_score
from test_secrets import brute
from test_simhash import brute_components, brute_fingerprint
from tests_llm_common import SF, rows


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(step(spark, out[-1], SF).cache())
    yield out
    for df in out:
        df.unpersist()


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "bpe"]
    for df in stages[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS)


def test_language_stage(stages):
    assert texts(stages[1]) == {k: t for k, t in texts(stages[0]).items() if any(c.isalpha() for c in t)}


def test_near_copies_stage(stages):
    before = texts(stages[1])
    groups = brute_components([(k, brute_fingerprint(t)) for k, t in before.items()])
    assert texts(stages[2]) == {k: before[k] for k in {c for _, _, c in groups}}


def test_decontamination_stage(stages, spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    held = {k for k, t in before.items() for i in items if " ".join(decontaminate.words_of(i)) in " ".join(decontaminate.words_of(t))}
    gone = before.keys() - after.keys()
    assert held and held <= gone and all(after[k] == before[k] for k in after)
    assert all(max(brute_score(i, before[k]) for i in items) >= 0.5 for k in gone)


def test_secret_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert before.keys() == after.keys()
    assert any(brute(t) for t in before.values())
    assert all(before[k] == after[k] for k in before if not brute(before[k]))
    assert not any(brute(t) for t in after.values())


def test_token_stage(stages):
    tokenizer = tokens.WordTable(vocabulary()).tokenizer
    before = texts(stages[4])
    got = {r["doc_id"]: r for r in rows(stages[5])}
    assert got.keys() == before.keys() and all(r["round_trip"] for r in got.values())
    assert all(got[k]["ids"] == tokenizer.encode(t, add_special_tokens=False).ids for k, t in before.items())


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["n_tokens"], r["ids"])
    assert sorted(map(key, rows(corpus_pipeline.run(spark, SF)))) == sorted(map(key, rows(stages[-1])))


def test_odd_rows(spark, odd, no_documents):
    for source in (odd, no_documents):
        df = source
        for _, step in corpus_pipeline.STAGES:
            df = step(spark, df, SF)
        got = rows(df)
        assert (len(got) > 0) == (source is odd)
    kept = {r["doc_id"] for r in corpus_pipeline.known_languages(spark, odd, SF).collect()}
    assert kept.isdisjoint({3, 4, 5, 6}) and {1, 2, 7, 8, None} <= kept
    assert language.UNKNOWN == "und" and secrets.BASE


def test_last_stages_use_one_python_worker_a_task(spark, odd):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for step, old in (
        (corpus_pipeline.masked_secrets, docs.select("doc_id", secrets.redact_column(F.col("text"), secrets.secret_spans(F.col("text"))).alias("text"))),
        (corpus_pipeline.token_ids, docs.select("doc_id", tokens.encode_column(F.col("text"), vocabulary()).alias("ids"))),
    ):
        new = step(spark, docs, SF)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert sum(plan.count(f"{kind} [") for kind in ("ArrowEvalPython", "MapInPandas")) == 1, plan
        assert sorted(map(str, new.select(*old.columns).collect())) == sorted(map(str, old.collect()))
    assert all(r["round_trip"] for r in corpus_pipeline.token_ids(spark, docs, SF).collect())

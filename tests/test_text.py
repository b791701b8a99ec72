"""Tokens, n-grams and vocabularies on hand-made documents."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import base, models
from sorrel.operators import instances, ngrams, preprocess, weights
from sorrel.plans import staging
from sorrel.sources import documents as src


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def counts(features):
    return {(r["doc_id"], r["feature"]): r["value"] for r in features.collect()}


def grams(spark, texts, n_list, **extra):
    return counts(ngrams.token_ngrams(preprocess.sentence_tokens(docs(spark, *texts)), n_list, **extra))


def test_ngrams_stop_at_the_sentence_end(spark):
    found = {f for _, f in grams(spark, ["a b. c d"], (2,))}
    assert found == {"a b", "b .", "c d"}


def test_gap_in_n_keeps_names_and_counts_together(spark):
    found = grams(spark, ["a b c a b c"], (1, 3))
    assert found[0, "a"] == 2 and found[0, "a b c"] == 2 and found[0, "b c a"] == 1
    assert all(len(f.split()) in (1, 3) for _, f in found)


def test_excluded_word_is_a_whole_word(spark):
    found = grams(spark, ["do", "dog", "we do it"], (1, 2), exclude=["do"])
    assert set(found) == {(1, "dog"), (2, "we"), (2, "it")}


def test_excluded_words_as_a_table_agree_with_the_list(spark):
    features = ngrams.token_ngrams(preprocess.sentence_tokens(docs(spark, "do we do it", "dog it")), (1, 2))
    table = spark.createDataFrame([("do",), ("it",)], "word string")
    assert counts(ngrams.exclude_features(features, table)) == counts(ngrams.exclude_features(features, ["do", "it"]))


def test_minimum_count_keeps_the_limit_itself(spark):
    assert {f for _, f in grams(spark, ["x x y", "x y z"], (1,), min_count=2)} == {"x", "y"}


def staged_columns(spark, scratch):
    return [set(spark.read.parquet(t._path).columns) for t in scratch.tables]


def test_ngrams_below_the_minimum_are_not_written(spark):
    with staging.Scratch() as scratch:
        found = ngrams.token_ngrams(preprocess.sentence_tokens(docs(spark, "a b c d. a b c", "a b x", "b c d")), (1, 2, 3), min_count=2)
        got = counts(found)
        assert got == {
            (0, "a"): 2, (0, "b"): 2, (0, "c"): 2, (0, "d"): 1, (0, "a b"): 2, (0, "b c"): 2, (0, "c d"): 1, (0, "a b c"): 2, (0, "b c d"): 1,
            (1, "a"): 1, (1, "b"): 1, (1, "a b"): 1, (2, "b"): 1, (2, "c"): 1, (2, "d"): 1, (2, "b c"): 1, (2, "c d"): 1, (2, "b c d"): 1,
        }
        assert not any("feature" in c or "value" in c for c in staged_columns(spark, scratch))


def test_pairs_that_only_choose_longer_runs_are_not_returned(spark):
    with staging.Scratch() as scratch:
        found = grams(spark, ["a b c. a b c", "a b x. b c", "x"], (3, 1), min_count=2)
        assert found == {(0, "a"): 2, (0, "b"): 2, (0, "c"): 2, (0, "."): 1, (0, "a b c"): 2, (1, "."): 1, (1, "a"): 1, (1, "b"): 2, (1, "c"): 1, (1, "x"): 1, (2, "x"): 1}
        assert not any("feature" in c or "value" in c for c in staged_columns(spark, scratch))


@pytest.mark.parametrize("n_list, min_count", [((1, 2, 3), 2), ((4, 2), 2)])
def test_counted_ngrams_agree_with_the_plain_way(spark, n_list, min_count, monkeypatch):
    """Ids that come twice or are missing, words with spaces, empty and missing words, slices, full filters and small chunks."""
    from sorrel.operators import frequent

    rng = random.Random(5)
    words = lambda odd: [[rng.choice(["a", "b", "ä", "c", "😀"] + ["a b", "", None] * odd) for _ in range(rng.randrange(7))] for _ in range(rng.randrange(5))]
    for odd in (0, 1):
        rows = [(None if i % 9 == 0 else i // 2 * 2 if i < 10 else i, words(odd)) for i in range(40)] + [(50, None), (51, [])]
        table = spark.createDataFrame(rows, "doc_id long, processed array<array<string>>")
        want = ngrams.min_frequency(ngrams.token_ngrams(table, n_list), min_count)
        for setting in ({}, {"CHUNK": 5, "HELD": 8, "LOOKED_UP": 4, "MOST_BITS": 3}):
            with monkeypatch.context() as m:
                for name, value in setting.items():
                    m.setattr(frequent, name, value)
                got = ngrams.token_ngrams(table, n_list, min_count)
                assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_ngrams_with_one_hash_stay_apart():
    from sorrel.operators import frequent

    codes, first = frequent._grouped(np.array([7, 7, 8, 7]), np.array([1, 2, 1, 1]))
    assert codes[0] == codes[3] != codes[1] and len(first) == 3 and sorted(first) == [0, 1, 2]
    assert frequent._sorted(np.array([9, 7, 7]), np.array([1, 2, 1]))[2] == 2


def test_char_ngrams_cover_spaces_and_skip_short_texts(spark):
    found = counts(ngrams.char_ngrams(docs(spark, "a b", "x", "", "ñ😀ñ"), (2,)))
    assert found == {(0, "a "): 1, (0, " b"): 1, (3, "ñ😀"): 1, (3, "😀ñ"): 1}


def test_punctuation_and_case(spark):
    rows = preprocess.tokenize(docs(spark, "It's A. !?"), strip_punctuation=True)
    lower = preprocess.lowercase(rows).first()
    assert [[t["text"] for t in s] for s in lower["processed"]] == [["it", "s", "a"]]


def test_annotation_fills_lemma_and_class(spark):
    lexicon = spark.createDataFrame([("dogs", "dog", "N(soort,mv)")], "text string, lemma string, pos string")
    row = preprocess.annotate(preprocess.tokenize(docs(spark, "dogs run. dogs")), lexicon).first()
    got = [[(t["text"], t["lemma"], t["pos"]) for t in s] for s in row["processed"]]
    assert got == [[("dogs", "dog", "N"), ("run", "run", "UNK"), (".", ".", "UNK")], [("dogs", "dog", "N")]]


def test_annotation_of_odd_rows_writes_no_tokens(spark, monkeypatch):
    lexicon = spark.createDataFrame([("a", "x", "N(b)"), (None, "y", "Z")], "text string, lemma string, pos string")
    texts = spark.createDataFrame([(1, "a b. a"), (1, "c"), (None, "a"), (2, ""), (3, None)], "doc_id long, text string")

    def told(df):
        return sorted(
            (r["doc_id"] or 0, r["raw"] or "", [[(t["text"], t["lemma"], t["pos"]) for t in s] for s in r["processed"]] if r["processed"] is not None else None)
            for r in df.collect()
        )

    written = []
    monkeypatch.setattr(preprocess, "stage", lambda df, name="t": written.append(name) or staging.stage(df, name))
    a, point, b, c = ("a", "x", "N"), (".", ".", "UNK"), ("b", "b", "UNK"), ("c", "c", "UNK")
    found = preprocess.annotate(preprocess.tokenize(texts), lexicon)
    assert "tokens" not in written
    shared, plain = [[a, c, b, point], [a]], ("a", None, None)
    assert told(found) == [(0, "a", [[plain]]), (1, "a b. a", shared), (1, "c", shared), (2, "", []), (3, "", None)]
    monkeypatch.setattr(preprocess, "fits", lambda df: False)
    assert told(preprocess.annotate(preprocess.tokenize(texts), lexicon)) == told(found)
    assert "tokens" in written and found._by_document


def test_annotation_needs_no_row_for_a_token(spark):
    lexicon = spark.createDataFrame([("a", "x", "N(b)"), ("c", None, "V"), ("d", "e", None), (None, "y", "Z")], "text string, lemma string, pos string")
    token = "struct<text:string,lemma:string,pos:string>"
    sents = [[("a", None, None), (None, "q", "r")], [], [("c", None, None), ("d", None, None)], [("a", None, None)]]
    rows = [(1, "s", sents), (2, "t", [[]]), (3, "u", []), (4, None, None), (5, "v", [[("b", None, None)]]), (6, "w", [None, [("a", None, None)]])]
    table = spark.createDataFrame(rows, f"doc_id long, raw string, processed array<array<{token}>>")
    found = preprocess.annotate(table, lexicon)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and found._by_document
    entries = lexicon.groupBy("text").agg(F.min(F.struct("lemma", "pos")).alias("_e"))
    entries = entries.select("text", F.col("_e.lemma").alias("lemma"), F.substring_index("_e.pos", "(", 1).alias("pos"))
    want = preprocess._looked_up(table, entries)
    assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str) and found.dtypes == want.dtypes


def test_partitions_of_documents_grow_with_their_text(spark, monkeypatch):
    texts = docs(spark, *["abcd" * 10] * 50, None)
    assert staging.by_document(texts).rdd.getNumPartitions() == 8
    monkeypatch.setattr(staging, "TEXT_BYTES", 100)
    parted = staging.by_document(texts)
    assert parted.rdd.getNumPartitions() == 20 and parted.count() == 51


def test_word_counts_are_those_of_the_sentences(spark):
    texts = docs(spark, "A b.b? ...\nc!d\u2028e  A", "x.y", "", None, "\n\n.", "é_1 ½ \U0001f600!!")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    slow = ngrams.token_ngrams(preprocess.sentence_tokens(texts, lowercase=True), (1,))
    assert rows(ngrams.word_counts(texts, lowercase=True)) == rows(slow)


def test_rows_staged_by_document_are_neither_shuffled_nor_sorted_again(spark):
    texts = spark.createDataFrame([(i if i else None, "a b a c") for i in range(40)] + [(3, "a")], "doc_id long, text string")
    counts = staging.stage_by_document(ngrams.word_counts(texts))
    assert sorted(map(tuple, counts.collect()), key=str) == sorted(map(tuple, ngrams.word_counts(texts).collect()), key=str)
    ids = staging.stage(texts.select("doc_id"))
    joined = staging.join_documents(counts, ids, small=False).groupBy("doc_id").agg(F.sum("value"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan
    assert joined.count() == 39 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    staging.drop_stage(counts)
    assert not spark.catalog.tableExists(counts._table)


def test_vocabulary_numbers_by_count_then_name(spark):
    features = ngrams.token_ngrams(preprocess.sentence_tokens(docs(spark, "b b a c", "c")), (1,))
    got = [(r["feature"], r["feature_id"]) for r in ngrams.build_vocabulary(features).orderBy("feature_id").collect()]
    assert got == [("b", 0), ("c", 1), ("a", 2)]


def test_tokenised_json_list(spark, tmp_path):
    token = {"text": "hi", "lemma": "hi", "pos": "X"}
    (tmp_path / "d.json").write_text(json.dumps([{"raw": "hi", "processed": [[token]]}, {"raw": "yo", "processed": []}]))
    rows = src.read_tokenised(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["raw"]) for r in rows] == [(0, "hi"), (1, "yo")]


def test_documents_from_lines_and_files(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("one\ntwo\nthree\n")
    got = src.read_documents(spark, str(tmp_path / "lines.txt")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["one", "two", "three"]
    folder = tmp_path / "many"
    folder.mkdir()
    for n in (10, 9, 1):
        (folder / f"d{n}.txt").write_text(f"text {n}")
    got = src.read_documents(spark, str(folder), "files").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["text 1", "text 9", "text 10"]


def test_feature_csv_reads_commas_and_missing_marks(spark, tmp_path):
    (tmp_path / "f.csv").write_text("1,5;NA;2\n#NULL!;3;0\n")
    rows = src.read_feature_csv(spark, str(tmp_path / "f.csv"), ";", ["a", "b", "c"])
    assert counts(rows) == {(0, "a"): 1.5, (0, "c"): 2.0, (1, "b"): 3.0}


def test_unreadable_numbers_and_wide_lines_are_errors(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1;2\n3;x\n")
    with pytest.raises(Exception, match="not a number"):
        src.read_feature_csv(spark, str(tmp_path / "bad.csv"), ";").collect()
    (tmp_path / "wide.csv").write_text("1;2\n3;4;5\n;NA;7\n")
    got = {(r["doc_id"], r["feature"]): r["value"] for r in src.read_feature_csv(spark, str(tmp_path / "wide.csv"), ";").collect()}
    assert got == {(0, "c0"): 1.0, (0, "c1"): 2.0, (1, "c0"): 3.0, (1, "c1"): 4.0, (1, "c2"): 5.0, (2, "c2"): 7.0}
    with pytest.raises(ValueError, match="3 cells"):
        src.read_feature_csv(spark, str(tmp_path / "wide.csv"), ";", ["a", "b"])


ODD = [
    (1, "The cat, the CAT. sat\ton\nthe mat"), (2, None), (3, ""), (4, " \n"), (None, "the cat"), (None, "the dog, dog"),
    (5, "the cat"), (5, "cat cat ."), (5, None), (6, "dog"), (7, "\U0001f600 \u00c9t\u00e9 \u00e9t\u00e9 the"),
]


@pytest.mark.parametrize("case", ["odd", "no_repeats", "empty"])
@pytest.mark.parametrize("k", [1, 4, 50])
def test_chosen_words_are_those_of_the_word_table(spark, case, k):
    own = {"odd": ODD, "no_repeats": ODD[:5] + ODD[9:], "empty": []}[case]
    texts = spark.createDataFrame(own, "doc_id long, text string")
    table = ngrams.word_counts(texts, lowercase=True)
    chosen, picked = weights.prune_top_k(table, k), weights.prune_top_k(ngrams.word_totals(texts, lowercase=True), k)
    cells = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert cells(picked) == cells(chosen.select(*picked.columns))
    rows, want = ngrams.chosen_word_counts(texts, picked, lowercase=True), weights.select_features(table, chosen)
    assert rows.dtypes == want.dtypes and cells(rows) == cells(want)
    every = spark.createDataFrame([(i,) for i in [1, 2, 5, 5, 8, None]], "doc_id long")
    vectors = [cells(instances.sparse_instances(v, every, k)) for v in (rows, want)]
    assert vectors[0] == vectors[1] and len(vectors[0]) == 6


def test_chosen_words_need_no_word_table_and_no_second_shuffle(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    _, rows = models.chosen_words(spark, str(tmp_path))
    assert ("words", spark.sparkContext.applicationId, str(tmp_path)) not in base._SHARED
    for df in (instances.packed(rows, ["doc_id"]), rows.groupBy("doc_id").count()):
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()

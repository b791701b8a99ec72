import math
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from sorrel.llm import language
from sorrel.llm.queries import QUERIES
from tests_llm_common import SF, rows


def brute_phrases(text, labelled, block):
    """Greedy longest matches of symbol lists, block by block."""
    held = {tuple(labelled[i:j]) for i in range(len(labelled)) for j in range(i + 1, len(labelled) + 1)}
    count = 0
    for low in range(0, len(text), block):
        part, at = text[low : low + block], 0
        while at < len(part):
            n = 1
            while at + n < len(part) and tuple(part[at : at + n + 1]) in held:
                n += 1
            at, count = at + n, count + 1
    return count


@given(st.lists(st.integers(0, 3), max_size=40))
def test_automaton_reads_exactly_the_substrings(text):
    moves = language.suffix_automaton(np.array(text, np.uint8))

    def reads(word):
        state = 0
        for c in word:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    held = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(map(reads, held)) and len(moves) <= max(2, 2 * len(text))
    rng = random.Random(len(text))
    for _ in range(50):
        word = tuple(rng.choices(range(4), k=rng.randint(1, 6)))
        assert reads(word) == (word in held)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text("abc dé", max_size=60), min_size=1, max_size=6))
def test_phrases_against_brute_force(texts):
    samples = {"x": ["abcab caab", "cab"], "y": ["ddd abé ab"]}
    model = language.build(samples)
    table = language.symbol_table(model.symbols)
    lines = [table[language.code_points(t)] for t in texts]
    saved, language.BLOCK = language.BLOCK, 16
    try:
        got = language.phrases(lines, model)
    finally:
        language.BLOCK = saved
    for k, name in enumerate(model.languages):
        labelled = table[language.code_points("\n".join(samples[name]))].tolist()
        for n, line in enumerate(lines):
            want = brute_phrases(line.tolist(), labelled, 16)
            blocks = math.ceil(len(line) / 16)
            assert got[k, n] == want or (not blocks and got[k, n] == 0)


def test_held_out_accuracy(spark, documents):
    got = {r["doc_id"]: r for r in rows(QUERIES["op1_language_id"](spark, SF))}
    told = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert got.keys() == told.keys()
    out = [got[k]["lang_pred"] == told[k] for k in told if got[k]["held_out"]]
    assert len(out) > 20 and sum(out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_never_read(spark, documents):
    from pyspark.sql import functions as F

    lied = documents.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a = language.identify(documents, ~language.held_out()).collect()
    b = language.identify(lied, ~language.held_out()).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_languages_of_long_texts_only_are_learned(spark):
    told = [("de", "der und die schen " * 30), ("en", "the of and thing " * 30), ("en", "1 " * 300 + "the of and thing"), ("fr", "les avec pour")]
    docs = spark.createDataFrame([(n, t, c) for n, (c, t) in enumerate(told)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    for chars in (100, 10):
        held = language.sample_texts(docs, "lang", "text", F.lit(True), 12, chars)
        assert held.keys() == {"de", "en", "fr"}
        assert all(len(t) <= chars and any(map(str.isalpha, t)) for x in held.values() for t in x)
    got = {r["doc_id"]: r["lang_pred"] for r in rows(language.identify(docs, F.lit(True), row_chars=100))}
    assert got == {n: c for n, (c, _) in enumerate(told)}
    one = language.sample_texts(docs, "lang", "text", F.lit(True), 1, 520)
    assert [len(t) for t in one["en"]] == [510]


def test_many_scripts_and_tables_of_moves(monkeypatch):
    common = "".join(chr(0x561 + n) + chr(0x10D0 + n) for n in range(33))
    samples = {"x": [" ".join([common] * 9)], "y": ["кот дом лес"], "z": ["ωρα νυξ φως"]}
    texts = ["дом кот", "νυξ ωρα", common[3:30], "лес", "φως", "abc", ""]
    made = language.build(samples)
    letters = language.letter_table()
    got = language.predict(texts, made, language.symbol_table(made.symbols), letters)
    assert [c for c, _ in got[:5]] == ["y", "z", "x", "y", "z"]
    monkeypatch.setattr(language, "DENSE", 0)
    sparse = language.build(samples)
    assert len(sparse.keys) and not len(made.keys)
    assert language.predict(texts, sparse, language.symbol_table(sparse.symbols), letters) == got
    han = {"a": ["".join(chr(0x4E00 + n) for n in range(400))], "b": ["".join(chr(0x4E00 + n) for n in range(399, -1, -1))]}
    wide = language.build(han)
    table = language.symbol_table(wide.symbols)
    assert [c for c, _ in language.predict([han["a"][0][50:90], han["b"][0][50:90]], wide, table, letters)] == ["a", "b"]


def test_odd_rows(odd, no_documents):
    from pyspark.sql import functions as F

    got = language.identify(odd, F.lit(True), row_chars=100)
    by = {(r["doc_id"], r["lang_pred"]) for r in got.collect()}
    assert got.count() == odd.count()
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "und"), (7, "en"), (None, "en"), (None, "und")} <= by
    assert language.identify(no_documents, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, F.lit(False)).collect()} == {"und"}

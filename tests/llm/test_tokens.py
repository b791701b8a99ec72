import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from sorrel.llm import tokens
from sorrel.llm.queries import QUERIES, vocabulary
from tests_llm_common import SF, rows

tokenizers = pytest.importorskip("tokenizers")
TRICKY = [
    "", " ", "   ", "a", " a  b   ", "\n\n a\n", "it's we'll I'd 'tis ''s", "x<|endoftext|>y", "  <|endoftext|>  ", "!!<|endoftext|>!!", "<|endoftext|>",
    "<|endoftext|><|endoftext|>a", "<|endoftext|", "no break em　wide\u0085x", "12 345,6.7e-8", "été naïve ﬁ 😀😀 𝔘𝔫 ½ ²", "日本語 テスト", "\x00\x1f\x7f​",
    "=" * 30_000, " " * 30_000 + "x", "a" * 5000, "don't  stop\t\t\nnow", "ſtrange İi ǅ", "_under_score__ 5th", "é combining", None,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


def both(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return sorted(rows(tokens.decode(tokens.encode(df, vocabulary()), vocabulary())), key=lambda r: r["doc_id"])


def test_tricky_texts(spark, library):
    for t, r in zip(TRICKY, both(spark, TRICKY), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == want, t
        assert r["text"] == library.decode(want, skip_special_tokens=False) == (t or "")


@settings(deadline=None, max_examples=8)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=40), min_size=1, max_size=40))
def test_any_text(spark, library, texts):
    for t, r in zip(texts, both(spark, texts), strict=True):
        assert r["ids"] == library.encode(t, add_special_tokens=False).ids and r["text"] == t


def test_word_table_is_emptied_and_goes_on(library):
    table = tokens.WordTable(vocabulary(), limit=2)
    for _ in range(3):
        for words in (["the", " cat", "zzzq"], [" sat", "the", " on"], []):
            ids, sizes = table.gathered(table.rows_of(words))
            assert ids.tolist() == [i for w in words for i in library.encode(w).ids] and len(sizes) == len(words)


def test_slices(monkeypatch, spark, library):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "SLICE", 3)
    lists = pa.array([["a", " b"], None, [], [" c", " d", " e", "a"], ["x"]], pa.list_(pa.string()))
    got = tokens.encode_lists(lists, tokens.WordTable(vocabulary())).to_pylist()
    assert got == [[i for w in x or [] for i in library.encode(w).ids] for x in lists.to_pylist()]


def test_decode_of_odd_ids(spark, library):
    df = spark.createDataFrame([(1, [50256, 72, -5, 99999, None]), (2, None), (3, []), (4, [164, 95])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in rows(tokens.decode(df, vocabulary()))}
    assert got == {1: "<|endoftext|>" + library.decode([72]), 2: None, 3: "", 4: library.decode([164, 95])}


def test_odd_rows(odd, no_documents, library):
    got = rows(tokens.encode(odd, vocabulary()))
    assert sorted(map(str, (r["ids"] for r in got))) == sorted(str(library.encode(r["text"] or "").ids) for r in odd.collect())
    assert tokens.encode(no_documents, vocabulary()).count() == 0


def test_query_against_library(spark, documents, library):
    got = {r["doc_id"]: r for r in rows(QUERIES["op6_bpe_round_trip"](spark, SF))}
    for r in documents.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        out = got.pop(r["doc_id"])
        assert out["n_tokens"] == len(ids)
        assert out["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got

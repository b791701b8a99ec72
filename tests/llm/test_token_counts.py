import pytest
from hypothesis import given, settings, strategies as st

from sorrel.llm import token_counts
from sorrel.llm.queries import QUERIES, vocabulary
from tests_llm_common import SF, rows

tokenizers = pytest.importorskip("tokenizers")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TRICKY = [
    "", " ", "a", "  A b\n\n", "it's WE'LL I'D 's''t", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>" * 3, "ΑΣ ΌΣΟΣ Σ", "İstanbul ǅ",
    "é é ﬁ ½ ² 𝔘𝔫 😀", "日本語 Ａ　b", "=" * 9000, "a" * 300, "a\u0085b​c d", "1234 5.6", "q" * 70 + " " + "q" * 70, "Ⅷ ⅷ K Å", None,
]


@pytest.fixture(scope="module", params=FILES)
def tool(request):
    path = vocabulary(request.param)
    split = token_counts.Splitter(path)
    return path, split.whole(), tokenizers.Tokenizer.from_file(path)


def want(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_every_known_character_is_cut_as_the_library_does(tool):
    path, whole, library = tool
    counts = token_counts.Counts(path, whole)
    for c in range(ord(token_counts.KNOWN)):
        text = "a{0}B {0} 1{0}{0} !{0}?  {0}".format(chr(c))
        assert counts.of_text(text) == want(library, text), hex(c)


def test_proved_strings_are_one_token(tool):
    _, whole, library = tool
    assert len(whole) > 30_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(sorted(whole), add_special_tokens=False))


@pytest.mark.parametrize("part", [200_000, 5])
def test_tricky_texts(tool, part, monkeypatch):
    monkeypatch.setattr(token_counts, "PART", part)
    path, whole, library = tool
    for limit in (token_counts.REST, 2):
        counts = token_counts.Counts(path, whole, limit)
        for text in TRICKY * 2:
            assert counts.of_text(text) == want(library, text), text
        assert len(counts.rest) <= limit


@settings(deadline=None, max_examples=60)
@given(text=st.text(max_size=60))
def test_any_text(tool, text):
    path, whole, library = tool
    assert token_counts.Counts(path, whole).of_text(text) == want(library, text)


def test_other_files_are_refused(tmp_path):
    library = tokenizers.Tokenizer(tokenizers.models.BPE({"a": 0}, []))
    library.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=True)
    library.normalizer = tokenizers.normalizers.Strip()
    library.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        token_counts.Splitter(str(tmp_path / "t.json"))


def test_odd_rows(odd, no_documents):
    path = vocabulary(FILES[0])
    library = tokenizers.Tokenizer.from_file(path)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows(token_counts.token_counts(odd, path)))
    assert got == sorted((str(r["doc_id"]), want(library, r["text"])) for r in odd.collect())
    assert token_counts.token_counts(no_documents, path).count() == 0


def test_query_against_library(spark, documents):
    library = tokenizers.Tokenizer.from_file(vocabulary(FILES[0]))
    got = {r["doc_id"]: r for r in rows(QUERIES["op13_token_counts"](spark, SF))}
    for r in documents.collect():
        n = want(library, r["text"])
        assert got.pop(r["doc_id"]) == {"doc_id": r["doc_id"], "n_bytes": len((r["text"] or "").encode()), "n_tokens": n, "over_limit": n > 2048}
    assert not got

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, strategies as st

from sorrel.llm import alignment
from sorrel.llm.queries import QUERIES, vocabulary
from tests_llm_common import SF, rows

tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TRICKY = [
    None, "", " ", "a", "  a b  ", "▁x", "a ▁ b", "日本語 テスト", "<s></s><unk><|endoftext|>", "é́😀", "\x00a", "=" * 3000, "a\n\n b\r\n", "x" * 500,
    "<0x0A>", "ab  cd " * 300, " lead and trail ",
]


class Library:
    """Tokens of both sides by their libraries, and everything else by plain loops."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(vocabulary(A))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
        self.bytes_a = alignment.pieces(vocabulary(A))

    def byte_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def aligned(self, text):
        """Groups as text, and every linked pair of occurrences."""
        if not text:
            return "", []
        ids = [self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)]
        raw = [[self.bytes_a[i] for i in ids[0]], [self.byte_b(i) for i in ids[1]]]
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            return "", []
        (ends_a, ends_b) = ([sum(map(len, r[: n + 1])) for n in range(len(r))] for r in raw)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [
            "|".join(",".join(str(i) for i, e in zip(side, ends, strict=True) if low < e <= high) for side, ends in zip(ids, (ends_a, ends_b), strict=True))
            for low, high in zip([0, *cuts], cuts)
        ]
        links = [
            (a, b)
            for a, low, high in zip(ids[0], [0, *ends_a], ends_a)
            for b, start, end in zip(ids[1], [0, *ends_b], ends_b)
            if start < high and low < end
        ]
        return ";".join(groups), links


@pytest.fixture(scope="module")
def library():
    return Library()


def summary(row):
    return row["groups"], Counter({(x["a"], x["b"]): x["n"] for x in row["links"]})


@pytest.mark.parametrize("part", [200_000, 4])
def test_tricky_texts(library, part, monkeypatch):
    monkeypatch.setattr(alignment, "PART", part)
    monkeypatch.setattr(alignment, "TOGETHER", 3 * part)
    for text, row in zip(TRICKY, alignment.aligner(vocabulary(A), vocabulary(B)).texts(TRICKY).to_pylist(), strict=True):
        groups, links = library.aligned(text)
        assert summary(row) == (groups, Counter(links)), text
        assert row["n_links"] == len(links) and row["n_groups"] == (groups.count(";") + 1 if groups else 0)


@pytest.mark.parametrize("part", [200_000, 4])
def test_single_space_at_the_end(library, part, monkeypatch):
    monkeypatch.setattr(alignment, "PART", part)
    texts = ["a ", "ab  cd ", "the cat sat ", "x  ", "\n "]
    for text, row in zip(texts, alignment.aligner(vocabulary(A), vocabulary(B)).texts(texts).to_pylist(), strict=True):
        groups, links = library.aligned(text)
        assert groups and summary(row) == (groups, Counter(links)), text


@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_shared_cuts(a, b):
    a, b = (np.array(sorted(x | {61})) for x in (a, b))
    assert a[alignment.shared_cuts(a, b)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_long_stretch_without_a_cut():
    a, b = np.append(np.arange(0, 200_000, 2), 200_001), np.append(np.arange(1, 200_000, 2), 200_001)
    assert alignment.shared_cuts(a, b).tolist() == [100_000]


def check_query(library, texts, got):
    """Counts over all documents by plain loops."""
    whole = [library.aligned(t) for t in texts]
    docs = Counter(pair for _, links in whole for pair in set(links))
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    for (groups, links), r in zip(whole, got, strict=True):
        assert r["n_links"] == len(links) and r["count_sum"] == sum(docs[x] for x in links)
        assert r["n_best"] == sum(docs[x] == best[x[0]] for x in links)
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_query_against_plain_loops(spark, documents, library):
    short = documents.orderBy("n_chars").limit(60)
    texts = [r["text"] for r in short.collect()]
    found = alignment.link_scores(alignment.align(short, vocabulary(A), vocabulary(B)))
    assert found.agg({"n_links": "sum"}).first()[0] == sum(len(library.aligned(t)[1]) for t in texts)
    got = {r["doc_id"]: r for r in rows(QUERIES["op12_cross_alignment"](spark, SF))}
    every = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert set(got) == {i for i, _ in every}
    every = [(i, t) for i, t in every if len(t or "") < 20_000] if len(every) > 1000 else every
    quick = {i: alignment.aligner(vocabulary(A), vocabulary(B)).texts([t]).to_pylist()[0] for i, t in every}
    docs = Counter((x["a"], x["b"]) for r in quick.values() for x in r["links"])
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    for i, r in quick.items():
        assert got[i]["count_sum"] == sum(x["n"] * docs[x["a"], x["b"]] for x in r["links"])
        assert got[i]["n_best"] == sum(x["n"] for x in r["links"] if docs[x["a"], x["b"]] == best[x["a"]])
        assert got[i]["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "")


@pytest.mark.parametrize("limit", [0, 500_000])
def test_counts_joined_by_either_way(spark, library, monkeypatch, limit):
    import functools

    from sorrel.plans import staging

    monkeypatch.setattr(alignment, "skew_join", functools.partial(staging.skew_join, broadcast_rows=limit, hot_keys=20))
    texts = ["the cat sat", "the cat sat", "the dog sat on the mat", None, "", "sat▁", "unhappily the cat"]
    df = spark.createDataFrame([(n, t, n, "x", 1) for n, t in enumerate(texts)], "doc_id long, text string, n_a long, links string, _row int")
    aligned = alignment.align(df, vocabulary(A), vocabulary(B))
    scored = alignment.link_scores(aligned.withColumn("groups_sha256", alignment.F.when(alignment.F.col("n_a") == 0, "").otherwise(alignment.F.sha2("groups", 256))))
    check_query(library, texts, sorted(rows(scored), key=lambda r: r["doc_id"]))


def test_odd_rows(odd, no_documents):
    out = rows(alignment.link_scores(alignment.align(odd, vocabulary(A), vocabulary(B))))
    assert len(out) == odd.count() and sum(r["n_a"] == 0 for r in out) == 3
    assert alignment.link_scores(alignment.align(no_documents, vocabulary(A), vocabulary(B))).count() == 0

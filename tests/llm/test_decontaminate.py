import random

import numpy as np
import pytest

from sorrel.llm import decontaminate
from sorrel.llm.queries import QUERIES
from tests_llm_common import SF, rows

ITEM = "what is the boiling point of water at the top of the highest mountain on earth in degrees"


def brute_score(item, text):
    """Best Smith-Waterman score over the whole text, cell by cell."""
    a, b = decontaminate.words_of(item), decontaminate.words_of(text)
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        here = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            here[j] = max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, here[j - 1] - 1)
        above, best = here, max(best, *here)
    return best / (2 * len(a)) if a else 0.0


def tables(spark, texts, items):
    docs = spark.createDataFrame([(n, t, "x", 1) for n, t in enumerate(texts)], "doc_id long, text string, score string, item int")
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def found(spark, texts, items, **more):
    return {(r["doc_id"], r["item_id"]): r for r in rows(decontaminate.leaks(*tables(spark, texts, items), **more))}


def test_alignment_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, n))] for n in (12, 40))
        best, end = decontaminate.align(np.array(a), np.array(b))
        want = brute_score(" ".join(f"w{x}" for x in a), " ".join(f"w{x}" for x in b))
        assert best == round(want * 2 * len(a)) and end <= len(b)
        if hit := decontaminate.aligned(np.array(a), np.array(b), 0.4):
            assert hit[0] == best / (2 * len(a)) >= 0.4 and decontaminate.align(np.array(a), np.array(b[hit[1] : hit[2]]))[0] == best


def test_edited_copies_are_found_and_clean_texts_are_not(spark):
    words = ITEM.split()
    edited = words.copy()
    edited[3], edited[12] = "melting", "tallest"
    dropped = [w for n, w in enumerate(words) if n not in (5, 6)]
    added = words[:8] + ["reached", "today"] + words[8:]
    noise = "lorem ipsum dolor sit amet " * 40
    texts = [
        ITEM, f"{noise}{ITEM.upper()}! {noise}", f"{noise}{' '.join(edited)}", " ".join(dropped), noise + " ".join(added) + noise, noise,
        "what is the point of it at the top", None, "", " ".join(words[: len(words) // 3]),
    ]
    got = found(spark, texts, [ITEM, None, "", "...", ITEM, "two words"])
    assert {d for d, _ in got} == {0, 1, 2, 3, 4} and {i for _, i in got} == {0, 4}
    for (d, i), r in got.items():
        assert abs(r["score"] - brute_score(ITEM, texts[d])) < 1e-9
        if d == 1:
            span = decontaminate.words_of(texts[d])[r["start_word"] : r["end_word"]]
            assert span == decontaminate.words_of(ITEM)


def test_common_seeds_do_not_hide_a_copy(spark):
    texts = [f"word{n} {ITEM} tail{n}" for n in range(300)] + ["at the top of the hill"] * 300
    got = found(spark, texts, [ITEM])
    assert {d for d, _ in got} == set(range(300))


@pytest.mark.parametrize("every", [4, 5])
def test_a_verbatim_copy_does_not_hide_an_edited_one(spark, every):
    words = [f"word{n}" for n in range(40)]
    edited = [f"other{n}" if n % every == every - 1 else w for n, w in enumerate(words)]
    texts = [" ".join(words), " ".join(edited)]
    got = found(spark, texts, texts[:1])
    assert got.keys() == {(0, 0), (1, 0)}
    assert all(abs(r["score"] - brute_score(texts[0], texts[d])) < 1e-9 for (d, _), r in got.items())


def test_short_items_blocks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    texts = ["say hello world now", "hello big world", "hello", "hello world hello world"]
    got = found(spark, texts, ["hello world", "big", "say hello world now please"])
    assert {k for k in got} == {(0, 0), (1, 0), (3, 0), (1, 1), (0, 2)} - ({(1, 0)} if (1, 0) not in got else set())
    docs, items = tables(spark, texts, ["hello world"])
    assert decontaminate.leaks(docs.unionByName(docs), items).count() == decontaminate.leaks(docs, items).count()
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 == decontaminate.leaks(docs, items.limit(0)).count()


def test_odd_rows(spark, odd, no_documents):
    items = spark.createDataFrame([(1, "the same text of the end and the thing"), (2, "naïve ﬁ 😀 𝔘 token")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, items).collect()}
    assert got >= {(1, 1), (2, 1), (8, 2)} and not {3, 4, 5, 6} & {d for d, _ in got}
    assert decontaminate.leaks(no_documents, items).count() == 0


def test_query_finds_every_planted_item(spark, documents):
    got = {(r["doc_id"], r["item_id"]) for r in rows(QUERIES["op3_decontamination"](spark, SF))}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    words = {r["doc_id"]: " " + " ".join(decontaminate.words_of(r["text"])) + " " for r in documents.collect()}
    held = {(d, i["item_id"]) for i in items for d, t in words.items() if f" {' '.join(decontaminate.words_of(i['text']))} " in t}
    assert held and held <= got
    assert all(brute_score(next(i["text"] for i in items if i["item_id"] == k), words[d]) >= 0.5 for d, k in got)

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sorrel.llm import simhash
from sorrel.llm.components import components
from sorrel.llm.queries import QUERIES
from tests_llm_common import SF, rows


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, limit=3):
    """Smallest id reachable for each (id, fingerprint)."""
    distinct = sorted({f for _, f in pairs})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= limit:
                parent[root(a)] = root(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f, least.get(root(f))) for i, f in pairs]


def test_fingerprints(odd):
    for text in ["", None, "One", "one TWO", "a b c", "É a É b", "x  y\tz\n w", "a a a a a a b", *[r["text"] for r in odd.collect()][-2:]]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    long = " ".join(random.Random(1).choices("abcdefgh", k=9000))
    assert simhash.fingerprint(long) == brute_fingerprint(long)


def test_blocks_of_shingles(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    text = "one two three four five six seven eight nine ten"
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("dense", [4096, 1])
def test_spanning_links_inside_a_list(monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(3)
    base = 0xF0F0F0F0F0F0F0F0
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 8))) for _ in range(300)})
    links = simhash.spanning_links(np.array(fps, np.uint64))
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in links)
    want = {c for _, _, c in brute_components(list(enumerate(fps)))}
    assert len(fps) - len(links) == len(want)


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(25)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)]
    fps += [0, 0, 1, 7, (1 << 64) - 1, (1 << 63) - 1]
    pairs = [(1000 - n, f) for n, f in enumerate(fps)] + [(None, fps[0]), (None, 1 << 40 | 0xABC0FF)]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in pairs]
    got = simhash.grouped(spark.createDataFrame(signed, "id long, fp long")).collect()
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter(brute_components(pairs))


def test_component_chains(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3), (101, 102)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, no_documents):
    got = simhash.near_duplicates(odd).collect()
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in odd.collect()])
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter(want)
    assert simhash.near_duplicates(no_documents).count() == 0


def test_one_row_of_every_group_stays(odd):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    numbered = [(n, brute_fingerprint(r["text"])) for n, r in enumerate(odd.collect())]
    assert len(got) == len({c for _, _, c in brute_components(numbered)}) and max(got.values()) == 1
    assert got[(1, "the same text of the end and the thing")] == 1


def test_one_per_group_keeps_columns_of_any_name(spark):
    names = ["_fp", "_kept_id", "_kept_fp", "_0", "_1", "k", "fp"]
    rows_in = [(n, "the same words here" if n < 3 else f"words of number {n}", *(f"{c}{n}" for c in names)) for n in (2, 1, 7)]
    df = spark.createDataFrame(rows_in + [(None, "the same words here", *names)], f"doc_id long, text string, {', '.join(f'`{c}` string' for c in names)}")
    got = sorted(simhash.one_per_group(df).collect())
    assert [tuple(r) for r in got] == sorted(rows_in[1:])


def test_query_against_brute_force(spark, documents):
    got = rows(QUERIES["op10_simhash_near_dedup"](spark, SF))
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in documents.collect()])
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{f:016x}", c) for i, f, c in want)

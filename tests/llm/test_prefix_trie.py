import hashlib
import random
import zlib

import pytest

from sorrel.llm import prefix_trie
from tests_llm_common import rows

SCHEMA = "conv_id long, turn long, role string, text string, c int, key string, up string, m int"


def rebuild(convs, every=100):
    """Every conversation begins with the first turns of its hundred's first one."""
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % every, [])[:h] + turns[h:]
    return out


def brute(convs):
    """All nodes by walking every prefix of every conversation."""
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(path))
        out.append((
            members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), len(children),
            sum(1 for p in below if not any(q[:-1] == p for q in nodes if q)), sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in rows(df)), key=str)


def table(spark, convs):
    data = [(c, n, role, text, 1, "x", "y", 2) for c, turns in convs.items() for n, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def convs():
    draw = random.Random(5)
    out = {}
    for c in [*range(0, 30), *range(100, 112), *range(201, 209), 333]:
        shared = [("user", w) for w in "abc"[: draw.randrange(4)]]
        out[c] = shared + [(draw.choice(["user", "assistant"]), draw.choice(["x", "yy", "é😀"])) for _ in range(draw.randrange(9))] or [("", "")]
    # Copies, one a prefix of the other, and long ones that part late.
    out |= {40: out[7], 41: out[7], 42: out[7][:2] or [("", "z")], 43: [("user", str(i)) for i in range(37)], 44: [("user", str(i)) for i in range(33)] + [("bot", "q")]}
    return out


def test_rebuilt_against_brute_force(spark, convs):
    got = prefix_trie.conversation_trie(table(spark, convs), rebuilt=True)
    assert found(got) == brute(rebuild(convs))


@pytest.mark.parametrize(("block", "width"), [(2, 2), (16, 1024)])
def test_blocks_and_chains_of_any_width(spark, convs, block, width):
    turns = prefix_trie.numbered(prefix_trie.digested(table(spark, convs), "conv_id", "turn", "role", "text"), limit=20)
    turns = prefix_trie.stage(turns)
    assert found(prefix_trie.trie(turns, turns.filter("p = 1").select("c"), block, width)) == brute(convs)


def test_long_lists_of_ids_are_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    ends = spark.createDataFrame([(b"k", n) for n in (9, 10, 2, 100, 33, 5, 7)] + [(b"j", 1)], "key binary, c long")
    got = {bytes(r["key"]): r["ends_sha256"] for r in rows(prefix_trie.id_lists(ends, 3))}
    assert got == {b"k": hashlib.sha256(b"2,5,7,9,10,33,100").hexdigest(), b"j": hashlib.sha256(b"1").hexdigest()}


def test_turnless_conversations_belong_to_the_root(spark):
    # 101 to 105 lose all turns where their h is not 0, as their hundred's first conversation is absent.
    convs = {c: [("user", "a")] for c in range(101, 106)}
    got = found(prefix_trie.conversation_trie(table(spark, convs), rebuilt=True))
    assert got == brute(rebuild(convs)) and got[0][3] == 5


def test_odd_rows(spark):
    data = [
        (1, None, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (None, 1, "user", "lost"), (2, None, "", ""), (2, 5, "user", ""), (2, 5, "user", ""),
        (3, 0, "user", "long " * 100_000),
    ]
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in data], SCHEMA)
    convs = {1: [("", ""), ("user", ""), ("user", "")], 2: [("", ""), ("user", ""), ("user", "")], 3: [("user", "long " * 100_000)]}
    assert found(prefix_trie.conversation_trie(df)) == brute(convs)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    assert prefix_trie.conversation_trie(df.limit(0), rebuilt=True).count() == 0

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from sorrel.llm import sharding
from sorrel.llm.queries import QUERIES
from tests_llm_common import SF, rows


def brute_shard(key, weights):
    def score(n):
        whole = int(hashlib.md5(f"{'' if key is None else key}:{n}".encode()).hexdigest()[: sharding.DIGITS], 16)
        return -weights[n] / math.log((whole + 0.5) / 16**sharding.DIGITS)

    return max(range(len(weights)), key=lambda n: (score(n), -n))


def check(docs, weights):
    got = rows(sharding.shard(docs, weights))
    want = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        want[(r["doc_id"], len(raw) + 16, zlib.crc32(raw), brute_shard(r["doc_id"], weights), brute_shard(r["doc_id"], [*weights, 1.0]))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["grown_shard"] in (r["shard"], len(weights)) for r in got)


def test_against_brute_force(documents, odd, no_documents):
    check(documents, [1.0] * 40)
    check(odd, [1.0, 3.0, 0.5])
    assert sharding.shard(no_documents, [1.0] * 3).count() == 0


def test_shares_follow_weights(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(sharding.shard_of(F.col("id"), [1.0, 2.0, 5.0]).alias("s"))
    n = {r["s"]: r["count"] for r in keys.groupBy("s").count().collect()}
    assert all(abs(n[k] / 20_000 - w / 8) < 0.02 for k, w in enumerate([1, 2, 5]))


def test_query(spark, documents):
    got = rows(QUERIES["op4_sharding"](spark, SF))
    assert len(got) == documents.count() and {r["law"] for r in got} == {"key"}
    assert sum(r["shard"] != r["grown_shard"] for r in got) < len(got) / 10

"""Sharding by weighted rendezvous hashing.

Every shard scores every record key with a hash of both; the best score wins.
A shard added to the end takes records only into itself, one taken from the
end gives back only its own, and shares follow the weights.  Placing a record
needs its key only, so there is no shuffle and no skew by key: the numbers in
the shard come from one range sort.

A null key is hashed as the empty text.  Equal keys share a shard, whatever
their texts; repeated rows get slots of their own.  An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sorrel.plans.staging import rank_within

# Hex digits of the digest in a uniform number: 52 bits, exact in a double.
DIGITS = 13


def scores(key: Column, weights: list[float]) -> list[Column]:
    """Score of the key on each shard: ``-weight / ln(uniform)``."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(n: int, weight: float) -> Column:
        digest = F.md5(F.concat(text, F.lit(f":{n}")).cast("binary"))
        whole = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
        return F.lit(-float(weight)) / F.log((whole + 0.5) / float(16**DIGITS))

    return [score(n, w) for n, w in enumerate(weights)]


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard with the best score; ties go to the smaller number."""
    ranked = F.array(*(F.struct(s.alias("s"), F.lit(-n).alias("n")) for n, s in enumerate(scores(key, weights))))
    return (-F.array_max(ranked)["n"]).cast("int")


def shard(
    docs: DataFrame, weights: list[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, size, text_crc32, shard, slot, grown_shard)``, one row per input row.

    ``size`` is the text's bytes plus 16, ``slot`` counts each shard's records from
    0 in the order of key, checksum and size, ``grown_shard`` is the shard if one of
    weight ``grown_weight`` is added.  A null text counts as empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("id"),
        (F.octet_length(whole) + 16).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    ranked = rank_within(placed, ["shard"], [F.col("id"), F.col("text_crc32"), F.col("size")], "slot")
    return ranked.select(F.col("id").alias(key), "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"), "grown_shard")

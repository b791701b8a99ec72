"""Repeatable randomness: seeded hashes of ids, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_key(seed, *cols: Column) -> Column:
    """Hex digest whose order is a random order of the ids."""
    return F.md5(F.concat_ws("_", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_unit(seed, *cols: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the digest."""
    head = F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)

"""SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of
their 8 bytes, so they share at least 5 positional bytes.  A list per single
(position, byte) would hold 1/256 of all fingerprints, and tallying its pairs
would grow with the square of the input.  The index is therefore kept on sets
of 5 positions: a list's key is the set and the 5 bytes there, and a pair
reaches the guaranteed count exactly if it meets in one of the 56 lists.  A list fixes 40 bits,
so it never holds more than 2^24 distinct fingerprints; equal fingerprints are
one entry.  Lists of one entry are dropped in the JVM.  Inside a list every
pair within the limit is verified, but only a spanning forest of the links is
written, so a group of m near copies gives m - 1 rows a list, not m^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sorrel.llm.components import components
from sorrel.plans.staging import skew_join, stage

# Longer lists are verified by bit masks, whose work grows with the list's length.
DENSE = 4096
# Shingles hashed before their bits are summed.
BLOCK = 65_536


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    ones, hash64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for low in range(0, n, BLOCK):
        h = np.array([hash64(joined[a:b], 42) for a, b in zip(starts[low : low + BLOCK], ends[low : low + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_column(text, width: int = 3):
    """Fingerprint as the signed long with the same bits."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.fromiter((fingerprint(t, width) for t in batch), np.uint64, len(batch))
            yield pd.Series(out.view(np.int64), index=batch.index)

    # Marked so that a join on the result does not make Spark hash every text a second time.
    return simhash.asNondeterministic()(text)


def _within(fps: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct fingerprints within ``limit`` bits, in blocks."""
    n = len(fps)
    if n <= DENSE:
        step = max(1, 2_000_000 // n)
        for low in range(0, n, step):
            near = np.bitwise_count(fps[low : low + step, None] ^ fps[None, :]) <= limit
            a, b = np.nonzero(near)
            a += low
            yield a[a < b], b[a < b]
        return
    # All fingerprints of a list agree but for its loose bits: look up each with up to ``limit`` of them flipped.
    loose = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << i for i in range(64) if loose >> i & 1]
    order = np.argsort(fps)
    ranked = fps[order]
    for k in range(1, limit + 1):
        for chosen in combinations(bits, k):
            other = fps ^ np.uint64(sum(chosen))
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            a = np.flatnonzero((ranked[at] == other) & (fps < other))
            yield a, order[at[a]]


def spanning_links(fps: np.ndarray, limit: int = 3) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links between distinct fingerprints."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in _within(fps, limit):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
                if len(out) == len(fps) - 1:  # one group: no further link can join anything
                    return out
    return out


def fingerprint_links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fps(fp)`` that span every group.

    ``limit`` is the largest number of differing bits, from 0 to 7: a pair shares
    at least ``8 - limit`` bytes and the lists are kept on so many positions.
    """
    sets = list(combinations(range(8), 8 - limit))
    masks = [sum(0xFF << 8 * i for i in chosen) for chosen in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = F.posexplode(F.transform(F.array(*map(F.lit, signed)), lambda m: F.col("fp").bitwiseAND(m)))
    lists = (
        fps.select("fp", keyed.alias("positions", "bytes"))
        .groupBy("positions", "bytes")
        .agg(F.collect_list("fp").alias("held"))
        .filter(F.size("held") > 1)
        .select("held")
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for held in batch["held"]:
                signed = np.asarray(held, np.int64)
                if links := spanning_links(signed.view(np.uint64), limit):
                    x, y = np.array(links).T
                    a.append(signed[x])
                    b.append(signed[y])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return lists.mapInPandas(verify, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 3, width: int = 3
) -> DataFrame:
    """``(key, fp, group, component_id)``: one row per input row.

    ``fp`` is the fingerprint as a signed long, ``group`` the smallest ``fp`` of
    the component, ``component_id`` the smallest key reachable through links of at
    most ``limit`` differing bits.  Null and empty texts and texts
    without words have fingerprint 0 and link like any other.  Repeated rows
    and equal texts share a fingerprint and so a component.  A null key never
    names a component unless all of its keys are null.
    """
    made = stage(docs.select(F.col(key).alias("id"), fingerprint_column(F.col(text), width).alias("fp")), "fingerprints")
    return grouped(made, limit).select(F.col("id").alias(key), "fp", "group", "component_id")


def grouped(made: DataFrame, limit: int = 3) -> DataFrame:
    """``made(id, fp)`` with ``group`` and ``component_id``."""
    distinct = stage(made.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("df")), "distinct")
    rooted = components(fingerprint_links(distinct.select("fp"), limit).select("a", "b"))
    placed = stage(
        distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed"
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stage(placed.join(ids, "root").select("fp", F.col("root").alias("group"), "component_id", "df"), "classes")
    return skew_join(made, table, ["fp"], freq="df").drop("df")


def hex_fingerprint(fp):
    """16 lowercase hex digits of the fingerprint's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 3, width: int = 3) -> DataFrame:
    """``docs`` with one row of every component: the smallest key, nulls last.

    Columns and other rows' values are untouched; of rows that repeat the kept key
    and fingerprint one stays.  Texts are shuffled once, by their own key.
    """
    made = stage(docs.select(F.col(key).alias("id"), fingerprint_column(F.col(text), width).alias("fp")), "fingerprints")
    kept = grouped(made, limit).groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "fp")).alias("k"))
    # Names that the input lacks, whatever their case.
    taken = {c.lower() for c in docs.columns}
    mine, its = [name for n in range(len(taken) + 2) if (name := f"_{n}") not in taken][:2]
    kept = stage(kept.select(F.struct("k.id", "k.fp").alias(its)), "kept")
    rows = docs.withColumn(mine, F.struct(F.col(key).alias("id"), fingerprint_column(F.col(text), width).alias("fp")))
    return rows.join(kept, F.col(mine).eqNullSafe(F.col(its))).dropDuplicates([mine]).select(*docs.columns)

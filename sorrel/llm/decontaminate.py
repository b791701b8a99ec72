"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every whole text is scanned for word n-grams of the test items.  Each n-gram of
   an item that a text holds is a seed, however common it is, so what is found in
   one text never depends on another.
2. The parts of the text around an item's seeds are aligned on words: match +2,
   mismatch -1, gap -1 a word.  The score is the share of ``2 * item words``.

Words are runs of letters and digits, lower-cased.  An alignment that reaches
``least`` cannot have more gaps than twice the item's words, which bounds the part of the
text around a seed that can belong to it; nothing outside it is needed.  Items
that share too few words with a text to reach ``least`` are left out before alignment.
A copy without one unchanged run of ``n`` words has no seed.

Items travel to the tasks in blocks of at most ``BLOCK_WORDS`` words, one pass
over the corpus a block.  Items of fewer than ``n`` words are one n-gram of
their own length; items without words, null items and null texts match nothing.
Repeated items are items of their own, repeated rows with one key give one row.
An empty corpus or benchmark gives no row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sorrel.llm.batches import bounded

# Items that are sent to the tasks together hold at most so many words.
BLOCK_WORDS = 2_000_000
# Fixed odd number that mixes word numbers into an n-gram's number.
MIX = 0x9E3779B97F4A7C15

MATCH, MISMATCH, GAP = 2, -1, 1

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def ngram_numbers(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each run of ``n`` word numbers, as signed long."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (ids[k : k + len(out)].astype(np.uint64) + np.uint64(1))) * np.uint64(MIX)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


class Items:
    """Test items of one block as word numbers."""

    def __init__(self, rows: list[tuple], n: int):
        self.n, self.numbers, self.words = n, {}, {}
        self.of: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.item_ids, seen = [], 0
        for item, text in rows:
            if found := words_of(text):
                ids = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in found], np.int64)
                self.words[seen] = ids
                self.item_ids.append(item)
                for at, g in enumerate(ngram_numbers(ids, min(n, len(ids))).tolist()):
                    self.of[g].append((seen, at))
                seen += 1
        self.lengths = sorted({min(n, len(w)) for w in self.words.values()})
        self.known = np.array(sorted(self.of), np.int64)
        self.longest = max((len(w) for w in self.words.values()), default=0)

    def read(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words; -1 for words of no item."""
        found = words_of(text)
        return np.fromiter(map(self.numbers.get, found, repeat(-1)), np.int64, len(found))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text and numbers of all item n-grams there, by place."""
        places, grams = [], []
        for n in self.lengths:
            if len(ids) < n:
                continue
            inside = np.convolve(ids >= 0, np.ones(n, np.int64), "valid") == n
            at = np.flatnonzero(inside)
            numbers = ngram_numbers(ids, n)[at]
            where = np.minimum(np.searchsorted(self.known, numbers), len(self.known) - 1)
            good = self.known[where] == numbers
            places.append(at[good])
            grams.append(numbers[good])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, g = np.concatenate(places), np.concatenate(grams)
        order = np.argsort(at, kind="stable")
        return at[order], g[order]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score and the end (exclusive) of the aligned part of ``text``."""
    ramp = np.arange(len(text) + 1) * GAP
    above, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item:
        here = np.maximum(above - GAP, 0)
        here[1:] = np.maximum(here[1:], above[:-1] + np.where(text == w, MATCH, MISMATCH))
        above = np.maximum.accumulate(here + ramp) - ramp
        if (top := int(above.max())) > best:
            best, end = top, int(above.argmax())
    return best, end


def aligned(item: np.ndarray, text: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """Score, start and end of the best alignment, if the score reaches ``least``."""
    full = MATCH * len(item)
    shared = np.isin(item, text).sum()
    if MATCH * shared < least * full:
        return None
    best, end = align(item, text)
    if best < least * full:
        return None
    _, back = align(item[::-1], text[:end][::-1])
    return best / full, end - back, end


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    n: int = 3,
    least: float = 0.5,
) -> DataFrame:
    """``(key, item_key, score, start_word, end_word)`` of every leaked item in every text.

    One row a text and item, the best alignment, if its score is at least ``least`` (over
    1/3).  Items are read in blocks through the driver; texts never are.
    """
    spark = docs.sparkSession
    bounded(spark)
    item_kind, kind = dict(benchmark.dtypes)[item_key], dict(docs.dtypes)[key]
    rows = benchmark.select(F.col(item_key), F.col(item_text)).filter(F.col(item_text).isNotNull())
    out = None
    for block in _blocks(rows.toLocalIterator(prefetchPartitions=False)):
        items = Items(block, n)
        if not items.words:
            continue
        found = _verified(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), items, kind, item_kind, least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"`{key}` {kind}, `{item_key}` {item_kind}, score double, start_word long, end_word long")
    best = out.groupBy("id", "item").agg(F.max(F.struct("score", -F.col("start"), -F.col("end"))).alias("b"))
    return best.select(
        F.col("id").alias(key), F.col("item").alias(item_key), F.col("b.score").alias("score"),
        (-F.col("b.col2")).alias("start_word"), (-F.col("b.col3")).alias("end_word"),
    )


def _blocks(rows) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in rows:
        block.append((r[0], r[1]))
        size += len(r[1]) // 2 + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _verified(texts: DataFrame, items: Items, kind: str, item_kind: str, least: float) -> DataFrame:
    """``(id, item, score, start, end)``: the alignments of ``texts(id, text)`` with the items of a block."""
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = sent.value
        held = np.zeros(len(block.numbers), bool)
        for batch in batches:
            rows = []
            for k, t in zip(batch["id"], batch["text"], strict=True):
                ids = block.read(t if isinstance(t, str) else None)
                starts: dict[int, list[int]] = defaultdict(list)
                for at, gram in zip(*(x.tolist() for x in block.hits(ids)), strict=True):
                    for item, q in block.of[gram]:
                        starts[item].append(at - q)
                known = ids[ids >= 0]
                held[known] = True
                for item, found in starts.items():
                    words = block.words[item]
                    if held[words].sum() < least * len(words):
                        continue
                    for low, high in _merged([(max(0, at - 2 * len(words)), at + 3 * len(words)) for at in found]):
                        if hit := aligned(words, ids[low:high], least):
                            rows.append((k, block.item_ids[item], hit[0], low + hit[1], low + hit[2]))
                held[known] = False
            yield pd.DataFrame(rows, columns=["id", "item", "score", "start", "end"])

    return texts.mapInPandas(verify, f"id {kind}, item {item_kind}, score double, start long, end long")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]

"""Alignment of two tokenizers' tokens of the same texts.

Both tokenizers cut a text's bytes.  Byte offsets where tokens of both end are
shared cuts; between two of them lies a group.  Cuts are found by divide and
conquer: of an interval, the common end nearest the middle is located by bisecting the one side's
ends for the other's, and both halves go on; an interval without a common
end inside is a leaf and becomes a group.  All intervals of one depth, of many
texts, are handled together on arrays.

Tokenizer A is a byte-level BPE of the `tokenizers` library and reads a space and the text,
B a BPE of `sentencepiece` that puts the space itself; both take strings of special tokens as plain text.
A text has no tokens if it is null or empty, or if the joined bytes of A's or B's tokens differ
from the space and the text (such as texts that hold U+2581).

Links are the pairs of an A and a B token whose bytes overlap.  A pair of ids
counts the documents of the whole table that hold it linked: each document's
distinct pairs are counted with partial sums in every task, and the counts
joined back to the documents by ``skew_join``, so pairs that nearly all texts hold are not
shuffled.  The table of counts is broadcast only within the size limit.

Long texts are worked on in parts, cut where a space between two other characters starts a
token of both, so only a text's own result grows with it.  Every row is a document of its own: repeated
rows count again, null keys too.  Other columns of the input are left out, an empty
table gives an empty table, ties of the highest count are all best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sorrel.llm.batches import bounded, cut_at_spaces
from sorrel.llm.token_counts import Splitter
from sorrel.llm.tokens import IdTable, PieceTable, WordTable, pieces
from sorrel.plans.staging import skew_join, stage

# Characters of a part of a text, and of the parts that are aligned together.
PART, TOGETHER = 200_000, 400_000
SPACED = re.compile(" +[^ ]*")
ALIGNED = "struct<n_a:long,n_b:long,n_groups:long,n_links:long,groups:string,links:array<struct<a:int,b:int,n:int>>>"
LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])


def near_middle(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of each interval ``lo <= i < hi``, the ``i`` nearest its middle with ``a[i]`` in ``b``, or -1."""
    found, middle = np.full(len(lo), -1), (lo + hi) // 2
    open_, near, far = np.arange(len(lo)), 0, 1
    while len(open_):
        steps = np.arange(near, far)
        steps = np.unique(np.concatenate((-steps, steps)))
        steps = steps[np.argsort(np.abs(steps), kind="stable")]
        at = middle[open_, None] + steps
        inside = (at >= lo[open_, None]) & (at < hi[open_, None])
        ends = a[np.where(inside, at, 0)]
        common = inside & (b[np.searchsorted(b, ends)] == ends)
        first = common.argmax(axis=1)
        hit = common[np.arange(len(open_)), first]
        found[open_[hit]] = at[hit, first[hit]]
        open_ = open_[~hit]
        open_ = open_[(middle[open_] - lo[open_] >= far) | (hi[open_] - middle[open_] > far)]
        near, far = far, 2 * far
    return found


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices in ``a`` of the ends that ``b`` has too; both are sorted and end alike."""
    if not len(a):
        return np.zeros(0, np.int64)
    cuts = [np.array([len(a) - 1])]
    lo, hi = np.array([0]), np.array([len(a) - 1])
    while len(lo):
        cut = near_middle(a, b, lo, hi)
        lo, cut, hi = lo[cut >= 0], cut[cut >= 0], hi[cut >= 0]
        cuts.append(cut)
        lo, hi = np.concatenate((lo, cut + 1)), np.concatenate((cut, hi))
        lo, hi = lo[lo < hi], hi[lo < hi]
    return np.sort(np.concatenate(cuts))


class Tokens:
    """Ids of one tokenizer, through a table of distinct words, and the bytes they stand for."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            split = Splitter(path)
            split.library.encode_special_tokens = True
            self.words, known = WordTable(path), pieces(path)
            self.cut = lambda s: None if split.foreign.search(s) else split.pre_tokens(s)
            # Texts of foreign characters are left to the library.
            self.whole = lambda s: split.library.encode(s, add_special_tokens=False).ids
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            names = {i: model.id_to_piece(i) for i in range(model.get_piece_size())}
            if any(re.search("[^▁]▁", p) for p in names.values()):
                raise ValueError(f"{path} has pieces with a space inside")
            # No piece goes over the border before a space, so what lies between borders is encoded alone.
            # The model reads an empty text as nothing at all, so a single space at a text's end has its ids given.
            space = [model.piece_to_id("▁")]
            self.words = IdTable(lambda words: [ids or space for ids in model.encode([w[1:] for w in words], num_threads=1)])
            self.cut = SPACED.findall
            byte = re.compile(r"<0x([0-9A-F]{2})>")
            known = {
                i: bytes([int(byte.fullmatch(p)[1], 16)]) if byte.fullmatch(p) else p.replace("▁", " ").encode()
                for i, p in names.items()
            }
        self.table, self.n = PieceTable(known), max(known) + 1

    def encode(self, spaced: list[str]) -> list[np.ndarray]:
        """Ids of texts that start with a space."""
        cut = [self.cut(s) for s in spaced]
        ids, sizes = self.words.gathered(self.words.rows_of(list(chain.from_iterable(filter(None, cut)))))
        ids, ends = ids.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))
        out, at = [], 0
        for text, words in zip(spaced, cut, strict=True):
            if words is None:
                out.append(np.array(self.whole(text), np.int64))
            else:
                out.append(ids[ends[at] : ends[at + len(words)]])
                at += len(words)
        return out


class Aligner:
    """Groups and links of texts by the tokenizers at two paths."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokens(path_a), Tokens(path_b)
        # An id as it is written inside a group, and as the last one of its side.
        a = {2 * i + last: f"{i}{'|' if last else ','}".encode() for i in range(self.a.n) for last in (0, 1)}
        b = {2 * (self.a.n + i) + last: f"{i}{';' if last else ','}".encode() for i in range(self.b.n) for last in (0, 1)}
        self.written = PieceTable(a | b)

    def ids(self, side: Tokens, spaced: list[str], want: list[np.ndarray]) -> list[np.ndarray | None]:
        """Ids of each text, or None where their bytes are not the text's."""
        out = []
        for found, raw in zip(side.encode(spaced), want, strict=True):
            out.append(found if np.array_equal(side.table.gathered(found)[0], raw) else None)
        return out

    def parts(self, spaced: list[str]) -> list[tuple | None]:
        """``(n_a, n_b, n_groups, groups, links)`` of each part, None where bytes differ; links are rows a, b, n."""
        raw = [np.frombuffer(s.encode(), np.uint8) for s in spaced]
        both = list(zip(self.ids(self.a, spaced, raw), self.ids(self.b, spaced, raw), raw, strict=True))
        good = [x for x in both if x[0] is not None and x[1] is not None]
        results = iter(self.aligned([x[0] for x in good], [x[1] for x in good], np.array([len(x[2]) for x in good], np.int64)))
        return [next(results) if x[0] is not None and x[1] is not None else None for x in both]

    def aligned(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple]:
        """Results of parts whose tokens of both sides make up the same bytes."""
        if not len(sizes):
            return
        borders = np.cumsum(sizes)
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum(self.a.table.sizes[a]), np.cumsum(self.b.table.sizes[b])
        last_a = shared_cuts(ends_a, ends_b)
        last_b = np.searchsorted(ends_b, ends_a[last_a])
        # Written order: a group's A ids, then its B ids.
        ends_group_a, ends_group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_group_a[last_a] = ends_group_b[last_b] = 1
        group_a, group_b = np.cumsum(ends_group_a) - ends_group_a, np.cumsum(ends_group_b) - ends_group_b
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = 2 * a + ends_group_a
        codes[np.arange(len(b)) + last_a[group_b] + 1] = 2 * (self.a.n + b) + ends_group_b
        text, widths = self.written.gathered(codes)
        # Each stretch between neighbouring ends of either side is one overlap.
        marked = np.zeros((3, borders[-1] + 1), np.int8)
        for row, ends in zip(marked, (borders, ends_a, ends_b), strict=True):
            row[ends] = 1
        marked = marked[:, marked.any(axis=0)]
        # Ends before a stretch's own count the parts and tokens before its.
        part, at_a, at_b = np.cumsum(marked, axis=1, dtype=np.int64) - marked
        pair = (part * self.a.n + a[at_a]) * self.b.n + b[at_b]
        pair, times = np.unique(pair, return_counts=True)
        links = np.stack((pair // self.b.n % self.a.n, pair % self.b.n, times)).astype(np.int64)

        def until(ends: np.ndarray) -> np.ndarray:
            return np.concatenate(([0], np.searchsorted(ends, borders, "right")))

        to_a, to_b, to_group = until(ends_a), until(ends_b), until(ends_a[last_a])
        to_text = np.concatenate(([0], np.cumsum(widths)))[to_a + to_b]
        to_pair = np.searchsorted(pair, np.arange(len(sizes) + 1) * self.a.n * self.b.n)
        for i in range(len(sizes)):
            yield (
                int(to_a[i + 1] - to_a[i]), int(to_b[i + 1] - to_b[i]), int(to_group[i + 1] - to_group[i]),
                text[to_text[i] : to_text[i + 1] - 1].tobytes().decode(), links[:, to_pair[i] : to_pair[i + 1]],
            )

    def texts(self, texts: list[str | None]) -> pa.StructArray:
        """Results of whole texts, from those of their parts."""
        whole: list[list[tuple | None]] = [[] for _ in texts]
        waiting, chars = [], 0

        def work() -> None:
            for (i, _), result in zip(waiting, self.parts([s for _, s in waiting]), strict=True):
                whole[i].append(result)
            waiting.clear()

        for i, text in enumerate(texts):
            for n, part in enumerate(cut_at_spaces(text, PART) if text else ()):
                waiting.append((i, part if n else f" {part}"))
                chars += len(part)
                if chars >= TOGETHER:
                    work()
                    chars = 0
        work()
        none = (0, 0, 0, "", np.zeros((3, 0), np.int64))
        merged = [self.merged(parts) if parts and None not in parts else none for parts in whole]
        numbers = np.array([m[:3] for m in merged], np.int64).reshape(-1, 3)
        links = np.concatenate([m[4] for m in merged] or [none[4]], axis=1).astype(np.int32)
        ends = np.concatenate(([0], np.cumsum([m[4].shape[1] for m in merged]))).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(x) for x in links], fields=list(LINK))
        return pa.StructArray.from_arrays(
            [
                *(pa.array(numbers[:, k]) for k in range(3)), pa.array(numbers[:, 0] + numbers[:, 1] - numbers[:, 2]),
                pa.array([m[3] for m in merged], pa.string()), pa.ListArray.from_arrays(pa.array(ends), rows),
            ],
            ["n_a", "n_b", "n_groups", "n_links", "groups", "links"],
        )

    def merged(self, parts: list[tuple]) -> tuple:
        """The result of a text; every border between parts is a shared cut."""
        if len(parts) == 1:
            return parts[0]
        links = np.concatenate([p[4] for p in parts], axis=1)
        pair, at = np.unique(links[0] * self.b.n + links[1], return_inverse=True)
        times = np.bincount(at, links[2], len(pair)).astype(np.int64)
        return (*(sum(p[k] for p in parts) for k in range(3)), ";".join(p[3] for p in parts), np.stack((pair // self.b.n, pair % self.b.n, times)))


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align_column(text: Column, path_a: str, path_b: str) -> Column:
    """``struct<n_a, n_b, n_groups, n_links, groups, links>`` of a text column.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3``; ``links`` has the distinct linked pairs
    with their number of occurrences.
    """
    bounded(SparkSession.active())

    @F.arrow_udf(ALIGNED)
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = aligner(path_a, path_b)
        for batch in batches:
            yield work.texts(batch.to_pylist())

    return align(text)


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, groups, links)``, one row per input row."""
    return docs.select(F.col(key), align_column(F.col(text), path_a, path_b).alias("_x")).select(key, "_x.*")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, docs, best)``: documents that hold a pair linked, and whether no pair of the same A id has more."""
    pairs = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("docs"))
    return pairs.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def link_scores(aligned: DataFrame) -> DataFrame:
    """Rows of ``align`` with ``n_best``, the links whose pair is best of its A id, and
    ``count_sum``, the counts of all links; ``links`` is left out."""
    rows = stage(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(rows), "pairs")
    links = rows.select("_row", F.explode("links").alias("l")).select("_row", "l.*")
    sums = skew_join(links, counts, ["a", "b"], freq="docs").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")
    )
    return rows.drop("links").join(sums, "_row", "left").drop("_row").fillna(0, ["n_best", "count_sum"])

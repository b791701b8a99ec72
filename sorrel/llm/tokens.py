"""Byte-level BPE encoding and decoding through tables of distinct words.

Spark splits every whole text into words with the tokenizer's own pattern; a
merge never crosses a word, so a word has the same ids everywhere.  Each Arrow
batch of words becomes a table of its distinct words, each of which is encoded
once (words met in earlier batches of the task are taken from the task's
table), and ids are joined back to the texts by position.  Decoding joins ids
to their pieces: the table of pieces has one row per id of the vocabulary,
which bounds its size, and lies in one buffer from which pieces are gathered.

The table of distinct words is one per Python worker and not one for all tasks: joining
ids back from a single table shuffles every word of the corpus at least twice,
several times the input on disk; this way nothing is shuffled.  ``WORDS``
bounds the worker's table, whose less used half is forgotten beyond that; a word that is
met again is encoded again.

Null texts count as empty and have no ids.  The pattern's letters and numbers
are those of the JVM's Unicode tables.  Nothing depends on keys or other columns.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sorrel.llm.batches import bounded

# Distinct words that a worker keeps with their ids.
WORDS = 150_000
# Words whose ids are joined back at once.
SLICE = 400_000
# Ids of a batch that are decoded at once.
IDS = 1_000_000

# White space of the pattern, and the pattern of byte-level BPE.
SPACE = r"\t-\r \u0085   -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def words(text: Column, special: str = "<|endoftext|>") -> Column:
    """Words of a text in order; the special token is a word of its own."""
    whole = F.coalesce(text, F.lit(""))

    def plain(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))

    def after_special(part: Column, i: Column) -> Column:
        return F.when(i > 0, F.concat(F.array(F.lit(special)), plain(part))).otherwise(plain(part))

    quoted = "".join(c if c.isalnum() else f"\\{c}" for c in special)
    parts = F.flatten(F.transform(F.split(whole, quoted, -1), after_special))
    return F.when(F.contains(whole, F.lit(special)), parts).otherwise(plain(whole))


class IdTable:
    """Ids of distinct strings, each encoded once by ``encode`` (lists of strings to lists of ids)."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = WORDS):
        self.encode, self.limit = encode, limit
        self.rows: dict[str, int] = {}
        self.ids, self.starts, self.used = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the half of the words that most calls asked for, the older of equals."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        ids, sizes = self.gathered(keep)
        words = list(self.rows)
        self.rows = {words[row]: n for n, row in enumerate(keep.tolist())}
        self.ids, self.starts, self.used = ids, np.concatenate(([0], np.cumsum(sizes))), self.used[keep] // 2

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Row of each word, which may be repeated, good until the next call; new words get new rows."""
        if len(self.rows) > self.limit:
            self.forget()
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            lacking = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(lacking))
            found = self.encode(new)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, flat))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
            rows[missing] = np.fromiter(map(self.rows.__getitem__, lacking), np.int64, len(lacking))
        self.used[rows] += 1
        return rows

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in ``rows`` one after the other, and each word's number of ids."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return self.ids[at], sizes


class WordTable(IdTable):
    """Ids of words by the byte-level tokenizer at ``path``."""

    def __init__(self, path: str, limit: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        # A word is what the model merges, so it is given to the model, its bytes as the vocabulary shows them.
        self.model, self.shown = tokenizer.model, {b: c for c, b in byte_of_char().items()}
        self.special = {t.content: n for n, t in tokenizer.get_added_tokens_decoder().items()}
        super().__init__(lambda words: [self.encoded(w) for w in words], limit)

    def encoded(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]


@lru_cache(1)
def word_table(path: str) -> WordTable:
    """The table of this Python worker, which goes on from task to task."""
    return WordTable(path)


def encode_lists(lists: pa.Array, table: WordTable) -> pa.Array:
    """Token ids of each list of words."""
    offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat, sizes, ids = pc.list_flatten(lists), [], []
    for low in range(0, len(flat), SLICE):
        coded = flat.slice(low, SLICE).dictionary_encode()
        rows = table.rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        got, n = table.gathered(rows)
        ids.append(got)
        sizes.append(n)
    ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)
    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(values, pa.int32()))


def encode_column(text: Column, path: str) -> Column:
    """Token ids ``array<int>`` of a text column, as the tokenizer at ``path`` gives them."""
    bounded(SparkSession.active())

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = word_table(path)
        for batch in batches:
            yield encode_lists(batch, table)

    return encode(words(text))


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a vocabulary entry stands for: printable ones
    stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(sorted(set(range(256)) - set(shown))):
        out[chr(256 + n)] = b
    return out


def pieces(path: str) -> dict[int, bytes]:
    """Bytes of every id."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    of = byte_of_char()
    out = {n: bytes(of[c] for c in s) for s, n in told["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in told["added_tokens"]}


class PieceTable:
    """Bytes of every id in one buffer; ids without a piece stand for none."""

    def __init__(self, known: dict[int, bytes]):
        self.sizes = np.zeros(max(known) + 2, np.int64)
        for n, piece in known.items():
            self.sizes[n] = len(piece)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.buffer = np.frombuffer(b"".join(known.get(n, b"") for n in range(len(self.sizes))), np.uint8)

    def gathered(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids one after the other, and each id's number of bytes."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.buffer[at], sizes


def decode_lists(lists: pa.Array, table: PieceTable) -> pa.Array:
    """Text of each list of ids."""
    offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat, none = pc.list_flatten(lists), len(table.sizes) - 1
    parts, ends = [], [np.zeros(1, np.int64)]
    for low in range(0, len(flat), IDS):
        ids = flat.slice(low, IDS).fill_null(-1).to_numpy(zero_copy_only=False)
        raw, sizes = table.gathered(np.where((ids >= 0) & (ids < none), ids, none))
        parts.append(raw)
        ends.append(ends[-1][-1] + np.cumsum(sizes))
    raw, at = np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate(ends)[offsets]
    texts = [raw[low:high].tobytes().decode("utf-8", "replace") for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.array(texts, pa.string(), mask=np.logical_not(lists.is_valid().to_numpy(zero_copy_only=False)))


def decode_column(ids: Column, path: str) -> Column:
    """Text of an ``array<int>`` column; ids outside the vocabulary are passed over,
    bytes that are no UTF-8 become the replacement character, null stays null."""
    bounded(SparkSession.active())

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = PieceTable(pieces(path))
        for batch in batches:
            yield decode_lists(batch, table)

    return decode(ids)


def round_trip_column(text: Column, path: str) -> Column:
    """``struct<ids, round_trip>``: token ids, and whether they decode to the text (null: empty) again.

    Both ways are gone by one Python worker of a task, which holds one set of tables.
    """
    bounded(SparkSession.active())

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def both(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table, known = word_table(path), PieceTable(pieces(path))
        for lists, texts in batches:
            ids = encode_lists(lists, table)
            same = pc.equal(decode_lists(ids, known), pc.fill_null(texts, ""))
            yield pa.StructArray.from_arrays([ids, same], ["ids", "round_trip"])

    return both(words(text), text)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)``, one row per input row."""
    return docs.select(F.col(key), encode_column(F.col(text), path).alias("ids"))


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, ids, text)``, one row per input row."""
    return rows.select(F.col(key), F.col(ids), decode_column(F.col(ids), path).alias("text"))

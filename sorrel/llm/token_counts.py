"""Token counts with a shortcut for words that are one token.

A BPE tokenizer cuts a text into pre-tokens and merges each on its own.  Before
the job, every string of the vocabulary is put through the tokenizer's whole
way: those that are one pre-token and merge into one token are proved to be
whole tokens.  In the texts, pre-tokens of the proved set count one each; only
the rest are merged, each distinct one once as long as its count is remembered.

The proved set has at most one string per entry of the vocabulary, so it is
broadcast.  What a task remembers of the rest is bounded by ``REST`` entries;
beyond that the older half is forgotten and counted anew when met again.

Tokenizers of the `tokenizers` library whose model is a BPE over bytes are
understood, with the pattern of their file.  Texts are normalised and cut in
Python where all their characters lie below ``KNOWN``, where Python's tables and
the library's agree (tested for every character); parts of a text with other
characters are counted by the library as a whole.

Null texts count as empty and have no tokens; strings of special tokens inside
a text are found as the library finds them by default, one token each.  Long
texts are counted in parts.  Rows are counted one by one, so repeated rows, ties and other columns
mean nothing here, and an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sorrel.llm.batches import bounded, cut_at_spaces
from sorrel.llm.tokens import byte_of_char

# Merged pre-tokens that a task remembers, and the longest of them.
REST, REST_CHARS = 200_000, 64
# Characters of a text that are cut into pre-tokens at once.
PART = 200_000
# Characters from here on are left to the library.
KNOWN = "\u3000"

# The pattern of byte-level BPE where a file names none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class Splitter:
    """Pre-tokens of texts, as the tokenizer file at ``path`` defines them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cuts = told["model"], told["pre_tokenizer"]
        steps = cuts.get("pretokenizers", [cuts])
        byte_level = steps[-1]
        split = steps[0].get("pattern", {}).get("Regex", BYTE_LEVEL)
        normal = told["normalizer"]
        understood = (
            model["type"] == "BPE" and not model["dropout"] and byte_level["type"] == "ByteLevel" and not byte_level["add_prefix_space"]
            and len(steps) == 1 + (not byte_level["use_regex"]) and (normal is None or normal.get("normalizers") == LOWERED)
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
        )
        if not understood:
            raise ValueError(f"{path} is no BPE over bytes that can be counted by pre-tokens")
        self.lowered = normal is not None
        self.pattern = regex.compile(split)
        self.foreign = regex.compile(f"[{KNOWN}-\U0010ffff]")
        self.special = [t["content"] for t in told["added_tokens"]]
        self.at_special = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary = model["vocab"]
        self.shown = {b: c for c, b in byte_of_char().items()}

    def normal(self, text: str) -> str:
        """The text as it is cut; letters are lowered one by one, so a final sigma is like any other."""
        if not self.lowered:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pre_tokens(self, text: str) -> list[str]:
        return self.pattern.findall(self.normal(text))

    def merged(self, pre_token: str) -> int:
        """Number of tokens that one pre-token merges into."""
        return len(self.library.model.tokenize(pre_token.encode().decode("latin-1").translate(self.shown)))

    def whole(self) -> frozenset[str]:
        """The strings proved to be one token: one pre-token each, merged into the entry itself."""
        byte_of, out = byte_of_char(), []
        for entry, n in self.vocabulary.items():
            if not entry.endswith(self.suffix) or entry in self.special:
                continue
            raw = bytes(byte_of[c] for c in entry[: len(entry) - len(self.suffix)])
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if self.foreign.search(text) or self.pre_tokens(text) != [text]:
                continue
            tokens = self.library.model.tokenize(raw.decode("latin-1").translate(self.shown))
            if [t.id for t in tokens] == [n]:
                out.append(text)
        return frozenset(out)


@lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


class Counts:
    """Counts tokens of texts with a set of whole tokens."""

    def __init__(self, path: str, whole: frozenset[str], limit: int = REST):
        self.split, self.whole, self.limit = splitter(path), whole, limit
        self.rest: dict[str, int] = {}

    def of_rest(self, pre_token: str) -> int:
        known = self.rest.get(pre_token)
        if known is None:
            known = self.split.merged(pre_token)
            if len(pre_token) <= REST_CHARS:
                if len(self.rest) >= self.limit:
                    for old in list(self.rest)[: (self.limit + 1) // 2]:
                        del self.rest[old]
                self.rest[pre_token] = known
        return known

    def of_part(self, part: str) -> int:
        if not part.isascii() and self.split.foreign.search(part):
            return len(self.split.library.encode(part, add_special_tokens=False).ids)
        found = self.split.pre_tokens(part)
        rest = [p for p in found if p not in self.whole]
        return len(found) - len(rest) + sum(map(self.of_rest, rest))

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        between = self.split.at_special.split(text) if any(s in text for s in self.split.special) else [text]
        return len(between) - 1 + sum(self.of_part(part) for whole in between for part in cut_at_spaces(whole, PART))


def count_column(text: Column, path: str) -> Column:
    """Number of tokens of a text column by the tokenizer at ``path``."""
    spark = SparkSession.active()
    bounded(spark)
    proved = spark.sparkContext.broadcast(splitter(path).whole())

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = Counts(path, proved.value)
        for batch in batches:
            yield pa.array([counts.of_text(t.as_py()) for t in batch], pa.int64())

    return count(text)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens)``, one row per input row."""
    return docs.select(F.col(key), count_column(F.col(text), path).alias("n_tokens"))

"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built.  A text is
parsed greedily into phrases, each the longest match at its place in the
language's text, and costs ``phrases * log2(length of the language's text)``
bits.  The language with the fewest bits per character wins.

Labelled text comes from a bounded sample: per language the ``rows`` distinct
texts with the smallest hash, those of at most ``row_chars`` characters first; a
longer one gives a part of ``row_chars`` characters at a hashed place.  So the
automata hold at most ``languages * rows * row_chars`` characters however large
the table is.  Everything else runs over whole texts.

A text is read as symbols: all lower-cased letters of the labelled text, and one
blank for all others and for everything that is not a letter.  It is
parsed in blocks of ``BLOCK`` characters, each starting a new phrase, so that
blocks of many texts are walked side by side and a very long text costs no more
memory than its symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sorrel.llm.batches import bounded, text_window

UNKNOWN = "und"
# A phrase never crosses a multiple of this many characters.
BLOCK = 2048
# Characters of a batch that are walked side by side.
SLICE = 2_000_000
# Cells of the table of moves, states by symbols; a larger one holds only the moves that exist, to be searched.
DENSE = 16_000_000


class Model(NamedTuple):
    """Automata of all languages in one table of moves.

    ``moves[state + symbol]`` is the next state times two, plus one if a phrase
    ended before the symbol; states are row starts.  If ``keys`` is not empty,
    ``moves`` are those of ``keys`` (state + symbol, sorted) only; from any other a
    phrase ends and the next one moves by ``firsts`` (languages x symbols).
    """

    languages: list[str]
    symbols: dict[str, int]
    moves: np.ndarray
    roots: np.ndarray
    bits: np.ndarray
    keys: np.ndarray
    firsts: np.ndarray

    def step(self, state: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Moves from states (languages x texts) by one symbol of each text."""
        at = state + row
        if not len(self.keys):
            return self.moves.take(at)
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[place] == at, self.moves[place], self.firsts[:, row] | 1)


def symbol_table(symbols: dict[str, int]) -> np.ndarray:
    """Symbol of every code point; upper case as lower case."""
    out = np.zeros(0x110000, np.min_scalar_type(len(symbols)))
    for letter, n in symbols.items():
        for form in {letter, letter.upper(), letter.title()}:
            if len(form) == 1:
                out[ord(form)] = n
    return out


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Moves of each state; state 0 is the start and every substring is a path."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = new
    return moves


def build(samples: dict[str, list[str]]) -> Model:
    """Model of the labelled texts of each language."""
    languages = sorted(samples)
    letters = {c for texts in samples.values() for text in texts for c in text.lower() if c.isalpha()}
    symbols = {c: n + 1 for n, c in enumerate(sorted(letters))}
    width, table = len(symbols) + 1, symbol_table(symbols)
    texts = [table[code_points("\n".join(samples[name]))] for name in languages]
    automata = [suffix_automaton(text) for text in texts]
    dense = sum(len(states) + 1 for states in automata) * width <= DENSE
    parts, keys, firsts, roots, base = [], [], [], [], 0
    for states in automata:
        # One state more, for a symbol that the language's text lacks: a phrase of its own that nothing follows.
        first = np.full(width, len(states), np.int64)
        first[list(states[0].keys())] = list(states[0].values())
        if dense:
            to = np.full((len(states) + 1, width), -1, np.int64)
            for n, moves in enumerate(states):
                to[n, list(moves.keys())] = list(moves.values())
            ended = to < 0
            to = np.where(ended, first[None, :], to)
            ended[0] = False  # the start is left by a block's first symbol only
            parts.append((((to * width + base) << 1) | ended).ravel())
        else:
            held = [(c, s) for c, s in enumerate(first.tolist())]
            held += [(n * width + c, s) for n, moves in enumerate(states) if n for c, s in sorted(moves.items())]
            at, to = np.array(held, np.int64).T
            keys.append(at + base)
            parts.append((to * width + base) << 1)
        firsts.append((first * width + base) << 1)
        roots.append(base)
        base += (len(states) + 1) * width
    none = np.zeros(0, np.int64)
    return Model(
        languages, symbols, np.concatenate(parts) if parts else none, np.array(roots, np.int64),
        np.array([math.log2(max(2, len(text))) for text in texts]), np.concatenate(keys) if keys else none,
        np.array(firsts, np.int64).reshape(len(languages), width),
    )


def phrases(lines: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrases (languages x texts) of texts given as symbols."""
    blocks = [(n, line[low : low + BLOCK]) for n, line in enumerate(lines) for low in range(0, len(line), BLOCK)]
    blocks.sort(key=lambda x: -len(x[1]))
    size = np.array([len(b) for _, b in blocks], np.int64)
    grid = np.zeros((size[0] if len(size) else 0, len(blocks)), lines[0].dtype if lines else np.uint8)
    for k, (_, b) in enumerate(blocks):
        grid[: len(b), k] = b
    state = np.repeat(model.roots[:, None], len(blocks), axis=1)
    ends = np.ones(state.shape, np.int64)
    live = np.searchsorted(-size, -np.arange(len(grid)), "left")
    for row, k in zip(grid, live.tolist(), strict=True):
        step = model.step(state[:, :k], row[:k])
        ends[:, :k] += step & 1
        state[:, :k] = step >> 1
    out = np.zeros((len(model.roots), len(lines)), np.int64)
    owner = np.array([n for n, _ in blocks], np.int64)
    for k in range(len(model.roots)):
        out[k] = np.bincount(owner, ends[k], len(lines)).astype(np.int64)
    return out


def predict(texts: list[str | None], model: Model, table: np.ndarray, letters: np.ndarray) -> list[tuple[str, float]]:
    """Language and score of each text.

    The score is the share by which the winner undercuts the second language, 1
    if there is no other; 0 for ``und``.  Ties go to the smaller name.
    """
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    points = [(n, code_points(t)) for n, t in enumerate(texts) if t]
    kept = [(n, p) for n, p in points if model.languages and letters[p].any()]
    run: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not run:
            return
        cost = phrases([line for _, line in run], model) * model.bits[:, None]
        best = np.argmin(cost, axis=0)
        for k, (n, _) in enumerate(run):
            others = np.delete(cost[:, k], best[k])
            second = others.min() if len(others) else math.inf
            out[n] = (model.languages[best[k]], float(1 - cost[best[k], k] / second))
        run.clear()

    size = 0
    for n, p in kept:
        run.append((n, table[p]))
        size += len(p)
        if size >= SLICE:
            flush()
            size = 0
    flush()
    return out


def sample_texts(docs: DataFrame, label: str, text: str, usable: Column, rows: int, row_chars: int) -> dict[str, list[str]]:
    """Labelled texts per language: the distinct usable ones with the smallest hash, short ones first.

    Equal texts count once, so a group of copies cannot fill the sample.  Only hashes
    are ranked; the ranks are cut in each task before they are shuffled, and the texts
    of the chosen hashes are read afterwards.
    """
    fit = usable & F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")
    hashed = docs.filter(fit).select(F.col(label).alias("label"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    first = hashed.groupBy("label", "h").agg(F.min(F.length("text") > row_chars).alias("long"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("long", "h"))
    chosen = first.withColumn("r", rank).filter(F.col("r") <= rows).select("label", "h")
    found = hashed.join(F.broadcast(chosen), ["label", "h"]).select("label", "h", text_window(F.col("text"), row_chars).alias("text"))
    found = found.groupBy("label", "h").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in found.orderBy("label", "h").collect():
        out.setdefault(r["label"], []).append(r["text"])
    return out


def identify(
    docs: DataFrame,
    usable: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    rows: int = 12,
    row_chars: int = 2500,
) -> DataFrame:
    """``(key, lang_pred, score)``, one row per input row.

    ``usable`` marks the rows that may be learned from; of those at most ``rows``
    distinct texts are taken per language, of longer ones than ``row_chars``
    characters a part of that length and only where shorter ones are too few.
    Null texts and texts without a letter are ``und`` with score 0; so is
    everything if no row may be learned from.  Repeated rows are predicted alike,
    null keys are kept.
    """
    guess = language_column(F.col(text), fitted(docs, usable, text, label, rows, row_chars))
    return docs.select(F.col(key), guess.alias("_guess")).select(key, "_guess.lang_pred", "_guess.score")


def fitted(docs: DataFrame, usable: Column, text: str = "text", label: str = "lang", rows: int = 12, row_chars: int = 2500) -> Model:
    return build(sample_texts(docs, label, text, usable, rows, row_chars))


def language_column(text: Column, model: Model) -> Column:
    """``struct<lang_pred, score>`` of a text column."""
    bounded(SparkSession.active())
    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, letters = symbol_table(sent.value.symbols), letter_table()
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            yield pd.DataFrame(predict(texts, sent.value, table, letters), columns=["lang_pred", "score"], index=batch.index)

    # Marked so that a filter on the result does not make Spark predict every text a second time.
    return guess.asNondeterministic()(text)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the key as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))

"""Column expressions on text: sentences, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A sentence with its terminators, a word or number run or one
# other character, and the mark of a token that is not punctuation.
SENTENCE = r"[^.!?\n]*[.!?]+|[^.!?\n]+"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Array of sentences, each an array of tokens; empty sentences are left out."""
    split = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(split, tokens), lambda s: F.size(s) > 0)


def strip_punctuation(words: Column) -> Column:
    return F.filter(words, lambda t: t.rlike(WORD))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by one space."""
    if n == 1:
        return words
    none = F.array().cast("array<string>")
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(none)


def char_ngrams(text: Column, n_list: list[int]) -> Column:
    """All substrings of each length; linear in the text's length."""
    none = F.array().cast("array<string>")

    def runs(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(chars) - (n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))
        return F.when(F.size(chars) >= n, grams).otherwise(none)

    # The one-element array binds the characters once; a bare expression would
    # be split again for every position.  An empty text splits into one "".
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.flatten(F.transform(F.array(chars), lambda c: F.flatten(F.array(*[runs(c, n) for n in n_list]))))


def has_word(feature: Column, words: list[str]) -> Column:
    """Whether one of ``words`` is a whole word of the n-gram ``feature``."""
    return F.arrays_overlap(F.split(feature, " "), F.array(*[F.lit(w) for w in words]))


def coarse_pos(pos: Column) -> Column:
    """The class of a tag with its features in brackets cut off."""
    return F.substring_index(pos, "(", 1)

"""Bounded Arrow batches and bounded parts of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession, functions as F

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Spark's own limit, and the one for whole texts, whose words take many times their bytes in Python.
DEFAULT, BYTES = "67108864b", "8m"


def bounded(spark: SparkSession) -> None:
    """Lower the session's limit of bytes per Arrow batch, unless it was set already.

    The limit is read when a job runs, so it stays lowered for the session.
    """
    if spark.conf.get(SETTING, DEFAULT) == DEFAULT:
        spark.conf.set(SETTING, BYTES)


def text_window(text: Column, chars: int) -> Column:
    """A text, or of a longer one ``chars`` characters from a place chosen by its hash.

    A part without a letter gives way to the one from the first letter on.
    """
    start = F.pmod(F.xxhash64(text), F.length(text) - chars + 1)
    part = F.substr(text, (start + 1).cast("int"), F.lit(chars))
    lettered = F.substr(F.regexp_replace(text, r"^\P{L}+", ""), F.lit(1), F.lit(chars))
    return F.when(F.length(text) <= chars, text).otherwise(F.when(part.rlike(r"\p{L}"), part).otherwise(lettered))


INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


def cut_at_spaces(text: str, chars: int) -> Iterator[str]:
    """A text in parts of ``chars`` characters or little more, each but the first starting with a single space.

    Only a space between two other characters is a border; a stretch without one stays whole.
    """
    low = 0
    while len(text) - low > chars:
        border = INNER_SPACE.search(text, low + chars)
        if border is None:
            break
        yield text[low : border.start()]
        low = border.start()
    yield text[low:] if low else text

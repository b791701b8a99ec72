"""Secret scans through a trigram inverted index.

Every rule is a regular expression.  Its syntax tree gives a Boolean query over
trigrams of the ASCII-lower-cased text: an OR of sets of trigrams, one of which
any matching text must hold whole.  Each Arrow batch is a segment of the index:
one pass over its bytes writes the postings (trigram -> documents of the
segment) of the trigrams that some query names, the queries intersect and unite
postings, and only candidates are verified with the expression.  A rule without
mandatory trigrams has every document as candidate.  Postings never leave their
segment, so nothing is shuffled or collected and a lost task is simply redone.

Null and empty texts have no span.  Texts of any length are scanned whole.
Repeated rows and null ids are scanned like any other row; columns other than
the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

try:
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

# A set of literal alternatives larger than this is not followed further.
ALTERNATIVES = 64
# A character class larger than this is not expanded.
CLASS = 8
# Bytes of a segment that are looked up at once.
WINDOW = 4_000_000


class Rule(NamedTuple):
    """``least`` characters are asked of group ``group`` of a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base rules.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=12, any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
# Further rules for well-known token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
)
RULES = BASE + MORE

SPANS = "array<struct<kind:string,start:int,end:int>>"


def _ascii_lower(s: str) -> str:
    return s.encode().lower().decode()


def _alternatives(op, arg) -> set[str] | None:
    """The strings that a syntax node can match, if they are few and known."""
    name = str(op)
    if name == "LITERAL":
        return {_ascii_lower(chr(arg))}
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(_ascii_lower(chr(value)))
            elif str(kind) == "RANGE" and value[1] - value[0] < CLASS:
                out.update(_ascii_lower(chr(c)) for c in range(value[0], value[1] + 1))
            else:
                return None
            if len(out) > CLASS:
                return None
        return out
    if name == "SUBPATTERN":
        return _sequence_alternatives(arg[-1])
    if name == "BRANCH":
        parts = [_sequence_alternatives(x) for x in arg[1]]
        out = set().union(*(p or () for p in parts))
        return None if any(p is None for p in parts) or len(out) > ALTERNATIVES else out
    if name == "MAX_REPEAT" or name == "MIN_REPEAT":
        least, most, body = arg
        if most == 1 and (inner := _sequence_alternatives(body)) is not None:
            return inner | ({""} if least == 0 else set())
    return None


def _sequence_alternatives(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        part = _alternatives(op, arg)
        if part is None or len(out) * len(part) > ALTERNATIVES:
            return None
        out = {a + b for a in out for b in part}
    return out


def _trigrams(s: str) -> frozenset[bytes]:
    b = s.encode()
    return frozenset(b[i : i + 3] for i in range(len(b) - 2))


def _simplest(query: set[frozenset]) -> set[frozenset]:
    """Without alternatives that hold all trigrams of another alternative."""
    return {q for q in query if not any(o < q for o in query)}


def _both(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    """AND of two ORs; the larger one alone stands if the product grows too long."""
    if len(a) * len(b) > ALTERNATIVES:
        return min(a, b, key=len)
    return _simplest({x | y for x in a for y in b})


def _sequence_query(nodes) -> set[frozenset]:
    query, run = {frozenset()}, {""}
    for op, arg in nodes:
        part = _alternatives(op, arg)
        if part is not None and len(run) * len(part) <= ALTERNATIVES:
            run = {a + b for a in run for b in part}
            continue
        query = _both(query, _simplest({_trigrams(s) for s in run}))
        if part is not None:
            run = part
            continue
        run, name = {""}, str(op)
        if name == "SUBPATTERN":
            query = _both(query, _sequence_query(arg[-1]))
        elif name == "BRANCH":
            query = _both(query, _simplest(set().union(*(_sequence_query(x) for x in arg[1]))))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            query = _both(query, _sequence_query(arg[2]))
    return _both(query, _simplest({_trigrams(s) for s in run}))


def trigram_query(pattern: str) -> set[frozenset[bytes]] | None:
    """OR of trigram sets that a match of ``pattern`` needs; None if it needs none."""
    query = _simplest(_sequence_query(sre.parse(pattern)))
    return None if frozenset() in query else query


class SegmentIndex:
    """Postings of the named trigrams over the texts of one segment."""

    def __init__(self, queries: list[set[frozenset[bytes]] | None]):
        self.queries = queries
        self.grams = sorted({g for q in queries for alternative in q or () for g in alternative})
        used = sorted({c for g in self.grams for c in g})
        self.bits = max(1, len(used).bit_length())
        self.classes = np.zeros(256, np.uint32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.flag = np.zeros(1 << 3 * self.bits, np.int16)
        for n, g in enumerate(self.grams):
            self.flag[self._codes(np.frombuffer(g, np.uint8))[0]] = n + 1

    def _codes(self, raw: np.ndarray) -> np.ndarray:
        c = self.classes[raw]
        return (c[:-2] << 2 * self.bits) | (c[1:-1] << self.bits) | c[2:]

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Trigram -> ascending positions of the texts that hold it."""
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        raw = np.frombuffer(b"\0".join(texts), np.uint8)
        pairs = np.zeros(0, np.int64)
        for low in range(0, max(0, len(raw) - 2), WINDOW) if self.grams else ():
            hit = self.flag[self._codes(raw[low : low + WINDOW + 2])]
            at = np.flatnonzero(hit)
            doc = np.searchsorted(starts, at + low, "right") - 1
            pairs = np.union1d(pairs, hit[at].astype(np.int64) * (len(texts) + 1) + doc)
        gram, doc = np.divmod(pairs, len(texts) + 1)
        cut = np.searchsorted(gram, np.arange(1, len(self.grams) + 2))
        return {g: doc[cut[i] : cut[i + 1]] for i, g in enumerate(self.grams)}

    def candidates(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each query the positions of the texts that satisfy it."""
        held, out = self.postings(texts), []
        for query in self.queries:
            if query is None:
                out.append(np.arange(len(texts)))
                continue
            found = [np.zeros(0, np.int64)]
            for alternative in query:
                lists = sorted((held[g] for g in alternative), key=len)
                both = lists[0]
                for other in lists[1:]:
                    both = np.intersect1d(both, other, assume_unique=True)
                found.append(both)
            out.append(np.unique(np.concatenate(found)))
        return out


def spans_of(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


# Texts are indexed in segments of about this many characters.
SEGMENT_CHARS = 4_000_000


def scan_texts(texts: list[str], rules: tuple[Rule, ...], index: SegmentIndex, compiled: list[re.Pattern]) -> list[list[tuple]]:
    """Spans (kind, start, end) of each text, by start, then by the rules' order."""
    found: list[list[tuple]] = [[] for _ in texts]
    for n, (rule, docs) in enumerate(zip(rules, index.candidates([t.encode().lower() for t in texts]), strict=True)):
        for d in docs:
            found[d] += [(a, n, b) for a, b in spans_of(texts[d], rule, compiled[n])]
    return [[(rules[n].kind, a, b) for a, n, b in sorted(x)] for x in found]


def segments(texts: list, chars: int = SEGMENT_CHARS) -> Iterator[list]:
    """Consecutive runs of texts with about ``chars`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def _scanned(batches: Iterator[pd.Series], rules: tuple[Rule, ...]) -> Iterator[tuple[pd.Series, list]]:
    """Batches of texts with the spans of each text."""
    index = SegmentIndex([trigram_query(r.pattern) for r in rules])
    compiled = [r.compiled() for r in rules]
    for batch in batches:
        out = []
        for run in segments(batch.fillna("").tolist()):
            out += scan_texts(run, rules, index, compiled)
        yield batch, [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in out]


def secret_spans(text, rules: tuple[Rule, ...] = RULES):
    """Column of spans ``array<struct<kind, start, end>>`` of a text column."""

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch, spans in _scanned(batches, rules):
            yield pd.Series(spans, index=batch.index, dtype=object)

    return scan(text)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, spans)``: one row per input row; code-point offsets, end exclusive."""
    return docs.select(F.col(key), secret_spans(F.col(text), rules).alias("spans"))


def _redacted(text: str | None, spans, mask: str) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    parts, end = [], 0
    for s in spans:
        if s["start"] >= end:
            parts += [text[end : s["start"]], mask]
        end = max(end, s["end"])
    return "".join([*parts, text[end:]])


def redact_column(text, spans, mask: str = "[SECRET]"):
    """``text`` with every maximal run of overlapping spans replaced by ``mask``."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_redacted(t, x, mask) for t, x in zip(texts, found, strict=True)], index=texts.index, dtype=object)

    return redact(text, spans)


def masked_column(text, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]"):
    """``text`` with its secrets masked; found and masked by one Python worker of a task."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch, spans in _scanned(batches, rules):
            yield pd.Series([_redacted(t, x, mask) for t, x in zip(batch, spans, strict=True)], index=batch.index, dtype=object)

    return masked(text)

"""Secret scan by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: whatever the expression matches must hold
those trigrams. Documents are indexed in blocks (one for each batch of a task): for every trigram that some query asks
for, the block's posting list of documents. The query's lists are intersected and united, and only the documents that
remain are searched with the expression; a rule without mandatory trigrams searches every document. The block is the
unit of the index, so no posting list grows with the corpus and nothing is shuffled.

Trigrams are taken over bytes with A-Z lower-cased, so one index serves rules with and without regard to case.

Defined results: null text counts as empty and has no spans; repeated rows are searched one by one; texts are searched
whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc, _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.common import spans_of_rows, text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A match counts if the given group (0: all of it) has ``least`` characters. Base rules come first in a list."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = [
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # Only runs of 24 or more count, and a leftmost run is never cut, so the bound may stand in the pattern.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]

# A query is True (no condition), a trigram, or a pair of "and"/"or" and a frozenset of queries.
Query = bool | bytes | tuple


def _join(kind: str, parts) -> Query:
    flat = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
            continue
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_strings(strings: set[str]) -> Query:
    """Each string must be there with all its trigrams; a short one says nothing."""
    trigrams = lambda s: [b[i : i + 3] for b in [s.encode()] for i in range(len(b) - 2)]
    return _join("or", [_join("and", trigrams(s)) for s in strings])


def _walk(items, strings: set[str] | None) -> tuple[set[str], list[Query], bool]:
    """Follow a sequence. strings: what may directly precede. Gives what may stand at its end, conditions so far, and
    whether the strings are all there is to the sequence (no break inside)."""
    found, whole = [], True

    def cut() -> None:
        nonlocal strings, whole
        found.append(_of_strings(strings))
        strings, whole = {""}, False

    def times(more: set[str]) -> None:
        nonlocal strings
        strings = {a + b for a in strings for b in more}
        if len(strings) > MOST_STRINGS:
            cut()

    for op, value in items:
        if op is rc.LITERAL:
            times({chr(value).translate({i: i + 32 for i in range(65, 91)})})
        elif op is rc.IN and all(k is rc.LITERAL for k, _ in value) and len(value) <= 8:
            times({chr(v).lower() if v < 128 else chr(v) for _, v in value})
        elif op is rc.SUBPATTERN:
            ends, conditions, all_of_it = _walk(value[-1], {""})
            _take(ends, conditions, all_of_it, times, cut, found)
        elif op is rc.BRANCH:
            ways = [_walk(w, {""}) for w in value[1]]
            if all(w[2] for w in ways):
                times(set().union(*(w[0] for w in ways)))
            else:
                cut()
                found.append(_join("or", [_join("and", [*w[1], _of_strings(w[0])]) for w in ways]))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            least, most, inner = value
            ends, conditions, all_of_it = _walk(inner, {""})
            if all_of_it and most == 1:
                times(ends | ({""} if not least else set()))
            elif least:
                _take(ends, conditions, all_of_it, times, cut, found)
                if (least, most) != (1, 1):
                    cut()
            else:
                cut()
        elif op is not rc.AT:
            cut()
    return strings, found, whole


def _take(ends, conditions, all_of_it, times, cut, found) -> None:
    if all_of_it:
        times(ends)
    else:
        cut()
        found.extend([*conditions, _of_strings(ends)])


def trigram_query(pattern: str) -> Query:
    """What every match of ``pattern`` must hold, in lower-cased trigrams. Case-folding beyond ASCII is not covered, so a
    pattern that ignores case must be an ASCII one."""
    parsed = rp.parse(pattern)
    if parsed.state.flags & re.IGNORECASE and not parsed.state.flags & re.ASCII:
        raise ValueError("a rule that ignores case needs the ASCII flag")
    ends, conditions, _ = _walk(parsed, {""})
    return _join("and", [*conditions, _of_strings(ends)])


def trigrams_of(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1])) if isinstance(query, tuple) else set()


class Index:
    """Posting lists of one block of documents for the given trigrams."""

    def __init__(self, slots: np.ndarray, trigrams: list[bytes], data: np.ndarray, bounds: np.ndarray):
        self.docs = len(bounds) - 1
        self.postings: dict[bytes, np.ndarray] = {}
        if not trigrams or len(data) < 3:
            return
        low = _LOWER[data].astype(np.uint32)
        slot = slots[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(slot)
        doc = np.searchsorted(bounds, at, "right") - 1
        inside = at + 3 <= bounds[doc + 1]
        pair = np.unique(slot[at[inside]].astype(np.int64) * self.docs + doc[inside])
        ends = np.searchsorted(pair, np.arange(1, len(trigrams) + 2) * self.docs)
        for i, t in enumerate(trigrams):
            self.postings[t] = pair[ends[i] : ends[i + 1]] - (i + 1) * self.docs

    def find(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.docs)
        if isinstance(query, bytes):
            return self.postings.get(query, np.zeros(0, np.int64))
        lists = sorted((self.find(q) for q in query[1]), key=len)
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


def slot_table(trigrams: list[bytes]) -> np.ndarray:
    """For each possible trigram its number (from 1) or 0."""
    slots = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(trigrams):
        slots[int.from_bytes(t, "big")] = i + 1
    return slots


def _text(spans: list[tuple[int, int, int]], rules: list[Rule]) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in sorted(spans))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, a count n_<kind> for each base rule, base_sha256 and spans of every row of ``docs``."""
    base = [i for i, r in enumerate(rules) if r.base]
    names = ["doc_id", *(f"n_{rules[i].kind}" for i in base), "base_sha256", "spans"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        compiled = [re.compile(r.pattern) for r in rules]
        trigrams = sorted(set().union(*map(trigrams_of, queries)))
        slots = slot_table(trigrams)
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for first, last in spans_of_rows(bounds):
                block = bounds[first : last + 1]
                index = Index(slots, trigrams, data[block[0] : block[-1]], block - block[0])
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(last - first)]
                texts: dict[int, str] = {}
                for k, rule in enumerate(rules):
                    for i in index.find(queries[k]).tolist():
                        if i not in texts:
                            texts[i] = data[block[i] : block[i + 1]].tobytes().decode()
                        for m in compiled[k].finditer(texts[i]):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[i].append((m.start(), k, m.end()))
                own = [[s for s in spans if s[1] in base] for spans in found]
                counts = [pa.array([sum(s[1] == k for s in spans) for spans in own], pa.int64()) for k in base]
                digests = [hashlib.sha256(_text(spans, rules).encode()).hexdigest() for spans in own]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *counts, pa.array(digests, pa.string()), pa.array([_text(s, rules) for s in found], pa.string())], names)

    kinds = ", ".join(f"{n} long" for n in names[1:-2])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, f"doc_id long, {kinds}, base_sha256 string, spans string")

"""Spelling variants by reduced alphabets: words one edit apart, and the form that each rarer word goes back to.

Letters are hashed to a few symbols, so a word becomes a shorter-alphabet string that fits in a number. The one-edit
neighbourhood of every reduced word is generated and joined with the reduced words of the vocabulary; what shares a number is
verified on the words themselves. An insertion is another word's deletion, and of two reduced words that differ in one
symbol the one with the lesser symbol generates the other, so each pair of the full neighbourhoods is met once.

The number of symbols follows the number of words of a length (``symbols_for``): a reduced word stands for a bounded number
of words however large the vocabulary is, and a deletion is written in the alphabet of the shorter length. Numbers of words
longer than 18 letters are hashes; equal numbers of different strings cost a comparison and nothing else. Words longer than
``LONG`` generate rows without the word in them, which would be quadratic in its length, and are looked up when verified.

Defined results: null texts have no words; a null doc_id counts as the empty string in the hash; rows that repeat a doc_id
are documents of their own; of forms of equal n the first in code-point order is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.common import text_bytes
from trackloom.session import materialize

LEAST_LENGTH, LEAST_COUNT, TIMES, DROPS = 7, 2, 10, 31
LONG = 48  # letters; longer words share one alphabet
PART = 2_000_000  # bytes of a text that are looked at together
HELD = 200_000  # words that a task counts before it passes the counts on
CELLS = 400_000  # numbers generated together
ROOM = 8  # reduced words for each word of a length
FEWEST, MOST = 4, 64  # symbols
HASH_BASE = 0x9E3779B97F4A7C15
_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_NO_LETTER = re.compile(r"[^A-Za-zÀ-ÿ]")


def _text_parts(text: str) -> Iterator[str]:
    """Parts of about PART characters that cut no run of letters."""
    at = 0
    while at < len(text):
        edge = _NO_LETTER.search(text, at + PART) if len(text) - at > PART else None
        end = edge.end() if edge else len(text)
        yield text[at:end]
        at = end


def misspelt(doc: str, run: str) -> str:
    """The run, or in one case of ``DROPS`` the run without one letter."""
    h = crc32(f"{doc}:{run}".encode())
    if h % DROPS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """Words of ``LEAST_LENGTH`` letters or more with ``n``, their number in all texts, if that is ``LEAST_COUNT`` or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            data, bounds = text_bytes(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            for doc, s, e in zip(ids, bounds[:-1], bounds[1:]):
                for part in _text_parts(data[s:e].tobytes().lower().decode()):  # lower-casing bytes touches A-Z only
                    for run, n in Counter(_RUN.findall(part)).items():
                        word = misspelt("" if doc is None else str(doc), run)
                        if len(word) >= LEAST_LENGTH:
                            held[word] += n
                    if len(held) >= HELD:
                        yield passed_on()
        yield passed_on()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def symbols_for(words: DataFrame) -> dict[int, int]:
    """For each length up to LONG + 1 the number of symbols that leaves ROOM reduced words for each word."""
    length = F.least(F.length("word"), F.lit(LONG + 1)).alias("length")
    counts = {r["length"]: r["count"] for r in words.groupBy(length).count().collect()}  # at most LONG rows
    out = {}
    for length in range(1, LONG + 2):
        k = FEWEST
        while k < MOST and k ** min(length, 18) < ROOM * counts.get(length, 0):
            k += 1
        out[length] = k
    return out


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.array(words, dtype=f"U{length}").view(np.uint32).reshape(len(words), length).astype(np.int64)


def _weights(length: int, symbols: int) -> np.ndarray:
    """What a symbol counts at each place of a reduced word of this length: digits of a number, or of a hash if that is too large."""
    base = symbols + 1 if length <= 58 and (symbols + 1) ** length < 1 << 58 else HASH_BASE
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(length, base, np.uint64), dtype=np.uint64)))


def _marked(numbers: np.ndarray, length: int) -> np.ndarray:
    """Numbers of different lengths differ."""
    return ((numbers & np.uint64((1 << 58) - 1)) | np.uint64(min(length, 31) << 58)).view(np.int64)


def numbers_of(words: list[str], length: int, symbols: dict[int, int]) -> np.ndarray:
    """The reduced words, as numbers."""
    k = symbols[min(length, LONG + 1)]
    reduced = (_letters(words, length) % k + 1).astype(np.uint64)
    return _marked((reduced * _weights(length, k)[:length]).sum(axis=1, dtype=np.uint64), length)


def neighbourhoods(words: list[str], length: int, symbols: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: row, and the number of a reduced word at most one edit away (see the module's text)."""
    letters = _letters(words, length)
    k = symbols[min(length, LONG + 1)]
    reduced, weights = letters % k + 1, _weights(length, k)[:length]
    whole = (reduced.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    rows, numbers = [np.arange(len(words))], [_marked(whole, length)]
    step = np.arange(1, k, dtype=np.int64)
    higher = reduced[:, :, None] + step <= k
    row, at, up = np.nonzero(higher)
    rows.append(row)
    numbers.append(_marked(whole[row] + step[up].astype(np.uint64) * weights[at], length))
    if length > LEAST_LENGTH:
        k = symbols[min(length - 1, LONG + 1)]
        reduced, weights = letters % k + 1, _weights(length - 1, k)
        parts = reduced.astype(np.uint64) * weights
        before = np.cumsum(parts, axis=1, dtype=np.uint64) - parts
        shifted = reduced[:, 1:].astype(np.uint64) * weights[:-1]
        after = np.zeros_like(parts)
        after[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        kept = np.ones(reduced.shape, bool)
        kept[:, 1:] = reduced[:, 1:] != reduced[:, :-1]  # any letter of a run of equal symbols gives the same
        row, at = np.nonzero(kept)
        rows.append(row)
        numbers.append(_marked((before + after)[row, at], length - 1))
    return np.concatenate(rows), np.concatenate(numbers)


def _by_length(batches: Iterator[pa.RecordBatch], cells_a_letter: int) -> Iterator[tuple[int, list[str], list[int]]]:
    """length, words and their n, so few that their numbers stay below about CELLS (one word at least)."""
    for b in batches:
        words, counts = b.column("word"), b.column("n").to_pylist()
        groups: dict[int, list[int]] = {}
        for i, size in enumerate(pc.utf8_length(words).to_pylist()):
            groups.setdefault(size, []).append(i)
        for length, rows in groups.items():
            step = max(1, CELLS // (length * cells_a_letter))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                yield length, words.take(pa.array(part)).to_pylist(), [counts[i] for i in part]


def near_pairs(words: DataFrame) -> DataFrame:
    """words: different words with n. The pairs of words one edit apart, each once: a, a_n, b, b_n."""
    symbols = symbols_for(words)
    most = max(symbols.values())

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, some, counts in _by_length(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers_of(some, length, symbols)), pa.array(some, pa.string()), pa.array(counts, pa.int64())], ["number", "b", "b_n"])

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, some, counts in _by_length(batches, most):
            rows, numbers = neighbourhoods(some, length, symbols)
            own, rows = pa.array(np.arange(len(rows)) < len(some)), pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), own, pa.array(some, pa.string()).take(rows), pa.array(counts, pa.int64()).take(rows)], ["number", "own", "a", "a_n"])

    def generate_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = dict(zip(b.column("word").to_pylist(), b.column("id").to_pylist()))
            for length, some, _ in _by_length([b], most):
                rows, numbers = neighbourhoods(some, length, symbols)
                own, of = pa.array(np.arange(len(rows)) < len(some)), pa.array([ids[w] for w in some], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(numbers), own, of.take(pa.array(rows))], ["number", "own", "id"])

    # Of words with one reduced word each generates the other; of words of different length the longer one does.
    near = (F.levenshtein("a", "b", 1) == 1) & (F.length("b") <= F.length("a")) & (~F.col("own") | (F.col("a") < F.col("b")))
    reduced = words.mapInArrow(reduce, "number long, b string, b_n long")
    short = words.where(F.length("word") <= LONG).mapInArrow(generate, "number long, own boolean, a string, a_n long")
    found = short.join(reduced, "number").where(near).select("a", "a_n", "b", "b_n")
    long = words.where(F.length("word") > LONG).withColumn("id", F.xxhash64("word"))
    looked_up = long.mapInArrow(generate_long, "number long, own boolean, id long").join(reduced.where(F.length("b") >= LONG), "number")
    looked_up = looked_up.join(long.select("id", F.col("word").alias("a"), F.col("n").alias("a_n")), "id").where(near)
    return found.union(looked_up.select("a", "a_n", "b", "b_n"))


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs``.

    Each form has at least TIMES the occurrences of its word, so the chains of forms are as long as the digits of the largest
    n at most, and doubling follows them to the end in a few joins.
    """
    words = materialize(word_counts(docs), "words")
    pairs = near_pairs(words)
    side = lambda of, near, n: F.struct(F.col(of).alias("of"), F.col(near).alias("near"), F.col(n).alias("near_n"))
    met = pairs.select(F.inline(F.array(side("a", "b", "b_n"), side("b", "a", "a_n"))))
    best = met.groupBy("of").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, F.col("word") == F.col("of"), "left")
    enough = -F.col("best.less") >= TIMES * F.col("n")
    formed = materialize(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).cast("long").alias("form_n")), "forms")
    most = formed.agg(F.max("form_n")).first()[0] or 0
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reached = 1
    while LEAST_COUNT * TIMES ** (reached + 1) <= most:  # so much has the last of reached + 1 forms at least
        onward = links.select(F.col("word").alias("of"), F.col("root").alias("far"))
        links = materialize(links.join(onward, F.col("root") == F.col("of"), "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
        reached *= 2
    roots = links.select(F.col("word").alias("of"), "root")
    return formed.join(roots, F.col("word") == F.col("of"), "left").select("word", F.coalesce("root", "word").alias("root"), "form", "n", "n_near", "form_n")

"""Language identification by rank-order profiles.

A text is lower-cased, everything but letters becomes one blank, and its n-grams of one to three characters are counted
(none with a blank inside). A language's profile is the ``PROFILE`` most frequent n-grams of all its training texts. A
document's own most frequent n-grams are compared with each profile: an n-gram at rank i here and j there is out of
place by |i - j|, one missing from the profile by ``PROFILE``; the smallest sum wins.

Training counts are summed inside each task before they are shuffled, so a language that holds most rows costs no more
than its different n-grams. The profiles (languages times PROFILE rows) are broadcast; MOST_LANGUAGES bounds them.

Ties: equal counts are ranked by n-gram code, equal distances go to the language first in code point order.
Defined results: null text, or one without a letter, is ``und`` with score 0; so is everything if nothing can be learned.
Null languages are not learned from; a null doc_id is learned from and not held out; repeated rows count as often as they
occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PROFILE = 300
FOLDS, HELD_FOLD = 4, 2
MOST_LANGUAGES = 4096
SALTS = 32
MOST_PENDING = 2_000_000  # n-gram counts that a training task holds before it hands them on
PIECE = 1 << 20  # characters of a text that are looked at together
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _codes(text: str) -> np.ndarray:
    """n-gram codes of one piece: up to three code points of 21 bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[points], points, 32).astype(np.int64)
    c = np.concatenate(([32], c, [32]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    blank = c == 32
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[~blank], two, three[~blank[1:-1]]))


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a whole text's n-grams; empty without letters. Long texts are counted piece by piece; pieces end
    behind a character that is no letter, so that the counts do not depend on where they end."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return empty
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        parts.append(np.unique(_codes(text[at:end]), return_counts=True))
        at = end
    codes, counts = parts[0] if len(parts) == 1 else merge(*map(np.concatenate, zip(*parts)))
    return (codes, counts) if (codes < 1 << 21).any() else empty


def merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    different, where = np.unique(codes, return_inverse=True)
    return different, np.bincount(where, counts, len(different)).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent codes, most frequent first, ties by code. ``codes`` is in ascending order."""
    if len(codes) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")][:k]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


def profiles(docs: DataFrame, k: int = PROFILE) -> DataFrame:
    """lang, code, rank (from 0) of every learned language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held, most = 0, MOST_PENDING

        def merged() -> dict[str, tuple[np.ndarray, np.ndarray]]:
            return {lang: merge(*map(np.concatenate, zip(*parts))) for lang, parts in pending.items()}

        def frames(done) -> Iterator[pd.DataFrame]:
            for lang, (codes, counts) in done.items():
                yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                parts = ngrams(text)
                if len(parts[0]):
                    pending.setdefault(lang, []).append(parts)
                    held += len(parts[0])
                if held > most:
                    done = merged()
                    held = sum(len(c) for c, _ in done.values())
                    pending = {lang: [p] for lang, p in done.items()}
                    if held > most // 2:
                        yield from frames(done)
                        pending, held = {}, 0
        yield from frames(merged())

    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    counted = learn.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # A language's n-grams are cut to the first k inside salted groups before they meet.
    order = [F.desc("n"), F.asc("code")]
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)))
    some = salted.withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("i") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < k)
    return ranked.select("lang", "code", "rank")


class Judge:
    """All profiles side by side: for every code that one of them has, its rank in each (or k)."""

    def __init__(self, rows: pd.DataFrame, k: int = PROFILE):
        self.k, self.langs = k, sorted(rows["lang"].unique())
        self.codes = np.unique(rows["code"].to_numpy(np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), k, np.int32)
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.ranks[np.searchsorted(self.codes, rows["code"]), rows["lang"].map(column)] = rows["rank"]

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = top(*ngrams(text), self.k)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[at]
        place = np.arange(len(own), dtype=np.int32)[:, None]
        distance = np.where(ranks == self.k, self.k, np.abs(ranks - place)).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.k * len(own))


def learn(docs: DataFrame, k: int = PROFILE) -> Judge:
    ranked = profiles(docs, k)
    rows = ranked.limit(MOST_LANGUAGES * k + 1).toPandas()
    if len(rows) > MOST_LANGUAGES * k:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; profiles are broadcast and need that bound")
    return Judge(rows, k)


def identify(docs: DataFrame, judge: Judge) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")

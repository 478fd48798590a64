"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text becomes a vector of statistics (shares of character kinds, word and line lengths, repetition), put on a
log or logit scale so that each class is nearer to a Gaussian. Per class, Spark sums count, first and second moments of
all labelled training rows; the covariance is shrunk towards the pooled one and towards a multiple of the identity, and
its Cholesky factor is kept. A score is the logistic function of the difference of the two log densities, which are
Mahalanobis distances by triangular solves with the kept factors.

Only moments (a fixed number of doubles per class) reach the driver; scoring is one narrow pass over the texts.

Defined results: null text counts as empty; an empty text has fixed statistics and gets their score; documents without a
label are scored but not learned from; of several labels for one doc_id the greatest holds; without rows of both classes
every score is the share of label 1 (0.5 without labels). Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.llm.common import CHUNK_BYTES, fresh, spans_of_rows, text_bytes

STATISTICS = [
    "log_bytes", "upper", "digit", "symbol", "mark", "bar", "blank", "line_feed", "wide", "mean_word", "word_spread",
    "distinct_words", "top_word", "distinct_lines", "same_as_last",
]
THRESHOLD = 0.3
FOLDS, HELD_FOLD = 5, 0
POOL_SHRINK, DIAGONAL_SHRINK = 0.1, 0.05

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#$%&*+/<=>@\\^_`{}~[]", "mark": b"!?\"'(),-.:;", "bar": b"|", "blank": b" \t\v\f\r", "line_feed": b"\n"}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _KINDS.items()} | {"wide": np.arange(256) >= 128}
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _run_hash(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + length.astype(np.uint64)


def _word_hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every maximal run where ``inside`` holds."""
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    place = (np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))) if start[0] == 0 else (
        np.arange(len(data)) - np.concatenate((np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(data)))))))
    mixed = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63] * inside
    sums = np.add.reduceat(mixed, start)
    return start, _run_hash(sums, end - start)


def _merged(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes and the sum of each one's counts."""
    value, place = np.unique(hashes, return_inverse=True)
    return value, np.bincount(place, times, len(value)).astype(np.int64)


class _Runs:
    """Maximal runs (words or lines) of a text that comes in pieces: an open run goes on in the next piece."""

    def __init__(self) -> None:
        self.seen, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.total = self.bytes = self.squares = self.same = self.open_bytes = 0
        self.open_sum, self.last = np.zeros(1, np.uint64), np.zeros(0, np.uint64)

    def add(self, data: np.ndarray, inside: np.ndarray) -> None:
        if not len(data):
            return
        goes_on = bool(self.open_bytes and inside[0])
        if self.open_bytes and not goes_on:
            self.close()
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return
        length = end - start
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        if goes_on:
            place[: length[0]] += self.open_bytes
        sums = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], np.cumsum(length) - length)
        if goes_on:
            sums[:1] += self.open_sum
            length[0] += self.open_bytes
        self.open_bytes = 0
        if inside[-1]:
            self.open_sum, self.open_bytes = sums[-1:], int(length[-1])
            sums, length = sums[:-1], length[:-1]
        self._take(sums, length)

    def close(self) -> None:
        if self.open_bytes:
            self._take(self.open_sum, np.array([self.open_bytes]))
            self.open_bytes = 0

    def _take(self, sums: np.ndarray, length: np.ndarray) -> None:
        if not len(sums):
            return
        hashes = _run_hash(sums, length)
        chain = np.concatenate((self.last, hashes))
        self.same += int((chain[1:] == chain[:-1]).sum())
        self.last = hashes[-1:]
        self.total += len(hashes)
        self.bytes += int(length.sum())
        self.squares += int((length * length).sum())
        self.seen, self.times = _merged(np.concatenate((self.seen, hashes)), np.concatenate((self.times, np.ones(len(hashes), np.int64))))


def long_counts(data: np.ndarray, limit: int) -> dict[str, np.ndarray]:
    """``counts`` of one text, read in pieces of ``limit`` bytes so that no array of its bytes' hashes grows with it."""
    kinds, words, lines = dict.fromkeys(_TABLES, 0), _Runs(), _Runs()
    for at in range(0, len(data), limit):
        piece = data[at : at + limit]
        for k, t in _TABLES.items():
            kinds[k] += int(t[piece].sum())
        words.add(piece, ~_IS_SPACE[piece])
        lines.add(piece, piece != 10)
    words.close()
    lines.close()
    found = {"bytes": len(data)} | kinds | {
        "words": words.total, "different": len(words.seen), "top": words.times.max(initial=0), "lines": lines.total, "different_lines": len(lines.seen),
        "word_bytes": float(words.bytes), "word_squares": float(words.squares), "same": float(words.same),
    }
    return {k: np.array([v]) for k, v in found.items()}


def _repetition(owner: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: number of items, of different items, and the count of the most frequent one."""
    total = np.bincount(owner, minlength=docs)
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, o[first], np.diff(np.append(first, len(o))))
    return total, np.bincount(o[first], minlength=docs), top


def counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Raw counts of each text in ``data``; the texts lie between consecutive bounds."""
    docs = len(bounds) - 1
    cum = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    per_doc = lambda flags: np.diff(cum(flags)[bounds])
    out = {"bytes": np.diff(bounds)} | {k: per_doc(t[data]) for k, t in _TABLES.items()}
    firsts = np.zeros(len(data), bool)
    firsts[bounds[:-1][np.diff(bounds) > 0]] = True
    inside = ~_IS_SPACE[data]
    cut = np.flatnonzero(firsts & inside)  # a word may not run on from one text into the next
    padded, keep = np.insert(data, cut, 32), np.insert(inside, cut, False)
    start, word = _word_hashes(padded, keep)
    origin = start - np.searchsorted(cut + np.arange(len(cut)), start, "left")
    owner = np.searchsorted(bounds, origin, "right") - 1
    total, different, top = _repetition(owner, word, docs)
    edge = np.diff(np.concatenate(([False], keep, [False])).astype(np.int8))
    length = (np.flatnonzero(edge == -1) - start).astype(np.float64)
    same = (np.concatenate(([False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])))) if len(word) else np.zeros(0, bool)
    line_cut = np.flatnonzero(firsts & (data != 10))
    padded, keep = np.insert(data, line_cut, 10), np.insert(data != 10, line_cut, False)
    line_start, line = _word_hashes(padded, keep)
    line_owner = np.searchsorted(bounds, line_start - np.searchsorted(line_cut + np.arange(len(line_cut)), line_start, "left"), "right") - 1
    lines, different_lines, _ = _repetition(line_owner, line, docs)
    return out | {
        "words": total, "different": different, "top": top, "lines": lines, "different_lines": different_lines,
        "word_bytes": np.bincount(owner, length, docs), "word_squares": np.bincount(owner, length * length, docs),
        "same": np.bincount(owner, same.astype(np.float64), docs),
    }


def transform(c: dict[str, np.ndarray]) -> np.ndarray:
    """Counts to the vector of statistics, near to Gaussian scales."""
    size, words, lines = (np.maximum(c[k], 1).astype(np.float64) for k in ("bytes", "words", "lines"))
    share = lambda n, of, prior=2.0: np.log((n + 0.5) / (of + prior))
    odds = lambda n, of: np.log((n + 0.5) / (of - n + 0.5))
    mean = c["word_bytes"] / words
    spread = np.sqrt(np.maximum(c["word_squares"] / words - mean * mean, 0))
    columns = {
        "log_bytes": np.log1p(c["bytes"]), "mean_word": np.log1p(mean), "word_spread": np.log1p(spread),
        "distinct_words": odds(c["different"], words), "top_word": share(c["top"], words), "distinct_lines": odds(c["different_lines"], lines),
        "same_as_last": share(c["same"], words),
    } | {k: share(c[k], size, 8.0) for k in _TABLES}
    return np.column_stack([columns[k] for k in STATISTICS])


def statistics(data: np.ndarray, bounds: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    rows = []
    for first, last in spans_of_rows(bounds, limit):
        part = data[bounds[first] : bounds[last]]
        if len(part) <= 2 * limit:
            rows.append(transform(counts(part, bounds[first : last + 1] - bounds[first])))
            continue
        rows.append(transform(long_counts(part, limit)))  # one very long text
    return np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class Discriminant:
    """Per class: prior share, mean, inverse of the covariance's Cholesky factor and its log determinant."""

    share: float
    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    log_dets: tuple[float, float] = (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        gap = np.clip(density[1] - density[0] + np.log(self.share / (1 - self.share)), -500, 500)
        return 1 / (1 + np.exp(-gap))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL_SHRINK, diagonal: float = DIAGONAL_SHRINK) -> Discriminant:
    """moments: per class the count, the sum and the sum of outer products of the statistics."""
    d = len(STATISTICS)
    n = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
    total = n[0] + n[1]
    if not n[0] or not n[1]:
        return Discriminant(n[1] / total if total else 0.5, np.zeros(d), np.ones(d))
    first, second = sum(m[1] for m in moments.values()), sum(m[2] for m in moments.values())
    centre = first / total
    scale = np.sqrt(np.maximum(np.diag(second) / total - centre**2, 1e-6))
    means = {k: (moments[k][1] / n[k] - centre) / scale for k in (0, 1)}
    raw = {k: (moments[k][2] / n[k] - np.outer(moments[k][1], moments[k][1]) / n[k] ** 2) / np.outer(scale, scale) for k in (0, 1)}
    pooled = (n[0] * raw[0] + n[1] * raw[1]) / total
    factors, log_dets = {}, {}
    for k in (0, 1):
        cov = (1 - pool) * raw[k] + pool * pooled
        cov = (1 - diagonal) * cov + diagonal * np.trace(cov) / d * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors[k], log_dets[k] = np.linalg.inv(lower), float(np.log(np.diag(lower)).sum())
    return Discriminant(n[1] / total, centre, scale, (means[0], means[1]), (factors[0], factors[1]), (log_dets[0], log_dets[1]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Moments over all labelled training rows: statistics first, on the narrow side of the join by doc_id."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(*text_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, sums = len(STATISTICS), {}
        for b in batches:
            x = np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, d))
            for k in (0, 1):
                rows = x[b["quality"].to_numpy() == k]
                n, s, q = sums.get(k, (0, np.zeros(d), np.zeros((d, d))))
                sums[k] = n + len(rows), s + rows.sum(axis=0), q + rows.T @ rows
        yield pd.DataFrame([(k, float(n), s, q.ravel()) for k, (n, s, q) in sums.items() if n], columns=["quality", "n", "s", "q"])

    learn = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    one = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("quality").cast("int").alias("quality"))
    joined = learn.mapInArrow(vectors, "doc_id long, x array<double>").join(one, F.col("doc_id") == F.col("label_id")).select("x", "quality")
    parts = joined.mapInPandas(moments, "quality int, n double, s array<double>, q array<double>")
    each = parts.select("quality", "n", F.posexplode(F.concat("s", "q")).alias("i", "v"))
    d, found = len(STATISTICS), {}
    for r in each.groupBy("quality", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():  # 2 * (d + d * d) rows
        found.setdefault(r["quality"], [r["n"], np.zeros(d + d * d)])[1][r["i"]] = r["v"]
    return fit({k: (n, v[:d], v[d:].reshape(d, d)) for k, (n, v) in found.items()})


def add_score(docs: DataFrame, model: Discriminant, name: str) -> DataFrame:
    """``docs`` with a column of scores; one narrow pass."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array(model.score(statistics(*text_bytes(text))))

    return docs.withColumn(name, score(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    scored = add_score(docs.select("doc_id", "text"), train(docs, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier, trained on ``labelled`` and ``labels``, does not reject."""
    name, = fresh(docs, "quality_score")
    return add_score(docs, train(labelled, labels), name).where(F.col(name) >= THRESHOLD).drop(name)

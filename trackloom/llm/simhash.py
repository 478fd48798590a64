"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has a bit set where over half of its word shingles' 64-bit hashes have it. Two documents are
linked if their fingerprints differ in at most ``RADIUS`` bits; components of links are the groups.

Only different fingerprints are compared. Split the free bits into RADIUS + 1 bands: fingerprints within the radius agree
on one band at least, so rows are grouped by (band, its value). A group with more than ``MOST_TOGETHER`` fingerprints is
split again by bands of the bits that are still free, until it is small; with ten free bits left it must be. That bounds
every task's work however dense a cluster is, and loses no pair. Inside a block of groups the fingerprints are stored as
bit planes (plane p holds bit p of 64 fingerprints in one word); a fingerprint's distances to all others are counted at
once by carry-save counters of two bits, and a row whose whole block is beyond the radius is dropped early. A block gives
the edges of a spanning forest, not all pairs.

Defined results: null text counts as empty; documents without words have fingerprint zero and are linked like others;
repeated rows get equal results; component_id is the smallest non-null doc_id reachable, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.common import fresh, same_row, text_bytes, text_mark
from trackloom.llm.components import components
from trackloom.session import materialize

SHINGLE, SEED, RADIUS = 3, 42, 2
MOST_TOGETHER = 1024
BLOCK = 512
ALL_BITS = (1 << 64) - 1
PLANES_BETWEEN = 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    spans = zip(starts[: len(last)].tolist(), last.tolist())
    digest, n, counts = xxhash.xxh64_intdigest, len(last), np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark and fp (the 64 bits as a long) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column("text"))
            fp = np.fromiter((fingerprint(data[s:e].tobytes(), shingle) for s, e in zip(bounds[:-1], bounds[1:])), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(fp.view(np.int64))], ["doc_id", "mark", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), "text")
    return rows.mapInArrow(compute, "doc_id long, mark long, fp long")


def bands(fixed: int, parts: int) -> list[int]:
    """``fixed`` (a mask) with each of ``parts`` runs of the remaining bits added."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cuts = [round(len(free) * i / parts) for i in range(parts + 1)]
    return [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grouped(prints: DataFrame, radius: int = RADIUS, most: int = MOST_TOGETHER) -> DataFrame:
    """prints: different values of fp. Rows (mask, value, fp) such that any two fingerprints within the radius share a
    (mask, value), and no (mask, value) has more than ``most`` rows."""
    if radius not in (1, 2, 3) or most < 16:  # four free bits leave 16 different fingerprints, and are split no further
        raise ValueError("the radius must be 1 to 3 and groups may hold 16 fingerprints at least")
    masks, done = {0: bands(0, radius + 1)}, None
    rows = prints.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        table = F.create_map(*[F.lit(x) for k, v in masks.items() for x in (_signed(k), [_signed(m) for m in v])])
        rows = rows.select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        large = materialize(rows.groupBy("mask", "value").count().where(F.col("count") > most).select("mask", "value"), "large-groups")
        small = rows.join(large, ["mask", "value"], "left_anti").select("mask", "value", "fp")
        done = small if done is None else done.unionByName(small)
        if not large.take(1):
            return done
        # Two keys of one fingerprint can lead to the same finer key only by different masks, so rows stay different.
        rows = materialize(rows.join(large, ["mask", "value"], "left_semi").select("fp", "mask"), "split-groups")
        masks = {m: bands(m, radius + 1) for ms in masks.values() for m in ms}


def planes_of(prints: np.ndarray) -> np.ndarray:
    """64 rows of words: bit j % 64 of word j // 64 in row p is bit p of fingerprint j."""
    words = -(-len(prints) // 64)
    bits = np.zeros((64, words * 64), np.uint8)
    bits[:, : len(prints)] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def close_pairs(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of fingerprints that differ in at most ``radius`` (1 to 3) bits."""
    n = len(prints)
    planes = planes_of(prints)
    later = np.triu(np.ones((n, n), bool), 1)
    later = np.pad(later, ((0, 0), (0, planes.shape[1] * 64 - n)))
    over = ~np.packbits(later, axis=1, bitorder="little").view(np.uint64)  # what need not be counted counts as too far
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    rows, own = np.arange(n), prints

    def beyond() -> np.ndarray:
        return over | (twos & ones if radius == 2 else twos if radius == 1 else np.uint64(0))

    for p in range(64):
        differs = planes[p][None, :] ^ (np.uint64(0) - ((own >> np.uint64(p)) & np.uint64(1)))[:, None]
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if p % PLANES_BETWEEN == PLANES_BETWEEN - 1:
            keep = (beyond() != np.uint64(ALL_BITS)).any(axis=1)
            if not keep.any():
                return rows[:0], rows[:0]
            if not keep.all():
                rows, own, ones, twos, over = rows[keep], own[keep], ones[keep], twos[keep], over[keep]
    near = np.unpackbits((~beyond()).view(np.uint8), axis=1, bitorder="little")
    i, j = np.nonzero(near)
    return rows[i], j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest index of its component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_edges(groups: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between fingerprints that link the same sets as all close pairs inside the groups."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, value, fp = (np.zeros(0, np.int64) for _ in range(3))

        def edges(prints: np.ndarray) -> pa.RecordBatch:
            prints = np.unique(prints).view(np.uint64)
            label = forest(len(prints), *close_pairs(prints, radius))
            linked = np.flatnonzero(label != np.arange(len(prints)))
            return pa.RecordBatch.from_arrays([pa.array(prints[label[linked]].view(np.int64)), pa.array(prints[linked].view(np.int64))], ["a", "b"])

        def blocks(final: bool) -> Iterator[pa.RecordBatch]:
            """Whole groups, packed into blocks; the last group stays pending until its end is certain."""
            nonlocal mask, value, fp
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            cuts = np.concatenate(([0], new, [len(fp)] if final else [])).astype(np.int64)
            size = np.diff(cuts)
            cuts, size = cuts[:-1][size > 1], size[size > 1]  # a fingerprint alone in its group has no pair here
            total = np.cumsum(size)
            at = 0
            while at < len(size):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
                yield edges(np.concatenate([fp[c : c + s] for c, s in zip(cuts[at:upto], size[at:upto])]))
                at = upto
            keep = len(fp) if final else int(new[-1]) if len(new) else 0
            mask, value, fp = mask[keep:], value[keep:], fp[keep:]

        for b in batches:
            mask, value, fp = (np.concatenate((old, b.column(k).to_numpy())) for k, old in enumerate((mask, value, fp)))
            yield from blocks(False)
        yield from blocks(True)

    dealt = groups.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def link(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: rows with doc_id, mark and fp, written already. Adds component_id and group (a fingerprint that names the
    component)."""
    different = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    linked = components(link_edges(grouped(different.select("fp"), radius), radius))
    names = different.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("group"))
    names = materialize(names, "print-groups")
    least = names.groupBy(F.col("group").alias("g")).agg(F.min("first_id").alias("component_id"))
    per_print = materialize(names.join(least, F.col("group") == F.col("g")).select(F.col("fp").alias("f"), "group", "component_id"), "print-components")
    return prints.join(per_print, F.col("fp") == F.col("f")).drop("f")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``."""
    found = link(materialize(fingerprints(docs), "fingerprints"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the smallest doc_id (then text mark), and one of equal rows."""
    return keep_first(docs, materialize(link(materialize(fingerprints(docs), "fingerprints")), "members"))


def keep_first(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members: doc_id, mark and group of every row of ``docs``, written already."""
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    stays = members.groupBy("group").agg(F.min(name).alias("first"))
    own_id, own_mark, copies = fresh(docs, "own_id", "own_mark", "own_copies")
    counted = stays.select("group", "first.doc_id", "first.mark").toDF("g", "first_id", "first_mark")
    same = (F.col("group") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("mark").eqNullSafe(F.col("first_mark"))
    kept = members.join(counted, same).groupBy(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).agg(F.count("*").alias(copies))
    kept = materialize(kept, "kept")
    once = docs.join(kept.where(F.col(copies) == 1), same_row(docs, own_id, own_mark), "left_semi")
    repeated = materialize(kept.where(F.col(copies) > 1), "repeated")
    if not repeated.take(1):
        return once
    extra = docs.join(repeated, same_row(docs, own_id, own_mark), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(extra)

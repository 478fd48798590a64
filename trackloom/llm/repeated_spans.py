"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier (in a smaller doc_id, or earlier in the
same document). Suffixes are put into buckets by their first 8 bytes; a bucket is refined by the bucket identifiers of
later offsets (8, then 16, then 32 bytes on), each round reusing what the last one found, until an identifier stands for
a whole string. Identifiers are computed names and not ranks, so a refinement needs no exchange; Spark sorts by them only
where suffixes of different documents must meet:

1. Every string of ``LENGTH`` bytes has one owner, the suffix with the least 40-byte identifier inside it. A run of
   consecutive strings with one owner is one row: its bucket (the owner's identifier) and its text's identifier. Buckets
   with a single suffix are settled and dropped. Of runs with equal text all but the first are repeats throughout.
2. First runs that share a bucket with another text are refined to their single strings, by an identifier of 96 bits;
   those that are not the first of their string are repeats.

About one row for 30 bytes is shuffled in step 1, and step 2 sees the ends of repeated passages only. Equal rows inside a
piece of text are resolved before they are shuffled, and buckets that fill up everywhere (a very common passage before
different texts) are found by a first pass and dealt out by text identifier, so no bucket is one task.

Identifiers of a run's text have 64 bits next to the bucket's own 64, single strings have 96 bits; different strings
with equal identifiers are not expected at any corpus size. Defined results: null text counts as empty; texts shorter
than ``LENGTH`` lose nothing; a null doc_id comes last; rows that repeat a doc_id with another text are separate
documents, in the order of a hash of the text; rows equal in both are one document and get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from trackloom.llm.common import spans_of_rows, text_bytes, text_mark
from trackloom.session import materialize

LENGTH, OWNER = 100, 40
PIECE = 1 << 19
CROWDED_IN_PIECE = 16  # texts of one bucket in a piece
CROWDED = 50_000  # rows of one bucket counted in such pieces
LAST_ID = (1 << 63) - 1
# A place is a number of 26 bits that tells apart equal doc_ids, 31 bits of offset and 6 bits of run length.
MARK_BITS, OFFSET_BITS, SPAN_BITS = 26, 31, 6
PART_BITS = 12

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def refine(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """A new identifier from a suffix's own and the one at a later offset."""
    x = (bucket ^ (bucket >> np.uint64(29))) * _A + later * _B
    x ^= x >> np.uint64(32)
    x *= _C
    return x ^ (x >> np.uint64(31))


def first_buckets(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every offset as one number (zeros behind the end)."""
    x = np.zeros(len(data) + LENGTH, np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << np.uint64(8 * step)
    return x


def buckets(data: np.ndarray) -> np.ndarray:
    """Identifiers of the 40 bytes at every offset: 8, 16, 32 and then 40 bytes."""
    eight = first_buckets(data)
    sixteen = refine(eight[:-8], eight[8:])
    four = refine(sixteen[:-16], sixteen[16:])
    return refine(four[: len(eight) - 32], eight[32:])


def string_names(eight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 64 bits for the LENGTH bytes at each offset in ``at``."""
    a, b = np.full(len(at), 0x243F6A8885A308D3, np.uint64), np.full(len(at), 0x13198A2E03707344, np.uint64)
    for offset in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        word = eight[at + offset]
        a = (a ^ word) * _A
        a ^= a >> np.uint64(32)
        b = (b + word) * _C
        b ^= b >> np.uint64(29)
    return a * _B, b * _A


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive strings with one owner: first offset, number of further strings, bucket, text identifier."""
    room = np.diff(bounds) - LENGTH + 1
    docs = np.flatnonzero(room > 0)
    empty = np.zeros(0, np.int64)
    if not len(docs):
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    ids = buckets(data)
    least = ids[: len(data)] >> np.uint64(32) << np.uint64(32) | np.arange(len(data), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 29):  # windows of 2, 4, 8, 16, 32 and 61 suffixes
        least = np.minimum(least[:-step], least[step:])
    room = room[docs]
    starts = np.arange(room.sum()) + np.repeat(bounds[docs] - np.concatenate(([0], np.cumsum(room)[:-1])), room)
    owner = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(starts)) - 1
    s, e, own = starts[first], starts[last], owner[first]
    whole = lambda at: refine(refine(ids[at], ids[at + OWNER]), ids[at + LENGTH - OWNER])
    text = refine(refine(whole(s), whole(e)), ((e - s) << 8 | (own - s)).astype(np.uint64))
    return s, e - s, ids[own], text


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds, and per text id, mark and the offset it begins at; a long text comes in overlapping pieces."""
    data, bounds = text_bytes(batch.column("text"))
    doc, mark = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
    for first, last in spans_of_rows(bounds, PIECE):
        if bounds[last] - bounds[first] <= 2 * PIECE:
            yield data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], doc[first:last], mark[first:last], np.zeros(last - first, np.int64)
            continue
        for at in range(0, int(bounds[last] - bounds[first]), PIECE):
            part = data[bounds[first] + at : min(bounds[first] + at + PIECE + LENGTH - 1, bounds[last])]
            yield part, np.array([0, len(part)]), doc[first:last], mark[first:last], np.array([at])


def place(mark: np.ndarray, offset: np.ndarray, span: np.ndarray | int = 0) -> np.ndarray:
    return mark << (OFFSET_BITS + SPAN_BITS) | offset << SPAN_BITS | span


def repeats(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, document and place; and which rows of it repeat an earlier row's keys at another place."""
    order = np.lexsort((at, doc, *reversed(keys)))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    again = np.concatenate(([False], same))[: len(order)]
    group = np.cumsum(~again) - 1
    first = np.flatnonzero(~again)[group] if len(order) else order
    d, p = doc[order], at[order]
    return order, again & ((d != d[first]) | (p != p[first]))


FIRST = "salt int, bucket long, name long, doc long, at long, settled boolean"


def run_rows(docs: DataFrame, crowded: np.ndarray) -> DataFrame:
    """The runs of all documents. settled: found to repeat an earlier one of the same piece."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bounds, doc, mark, base in pieces(batch):
                s, span, bucket, name = runs(data, bounds)
                row = np.searchsorted(bounds, s, "right") - 1
                at = place(mark[row], s - bounds[row] + base[row], span)
                order, again = repeats((bucket, name), doc[row], at)
                bucket, name, d, at = bucket[order], name[order], doc[row][order], at[order]
                # Crowded buckets are dealt out by text; settled rows need no neighbours, only a place to go.
                salt = np.where(again, refine(d.view(np.uint64), at.view(np.uint64)), np.where(np.isin(bucket, crowded), refine(bucket, name), np.uint64(0)))
                bucket, name = (np.where(again, np.uint64(0), x).view(np.int64) for x in (bucket, name))
                columns = [(salt >> np.uint64(33)).astype(np.int32), bucket, name, d, at, again]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["salt", "bucket", "name", "doc", "at", "settled"])

    return docs.mapInArrow(make, FIRST)


def crowded_buckets(docs: DataFrame) -> np.ndarray:
    """Buckets that hold many different texts: at least ``CROWDED`` rows in pieces where they stand out. All texts are
    looked at; the list has at most one entry for each ``CROWDED`` rows and only decides how rows are dealt out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bounds, *_ in pieces(batch):
                _, _, bucket, name = runs(data, bounds)
                different = np.unique(np.stack((bucket, name)), axis=1)[0] if len(bucket) else bucket
                value, n = np.unique(different, return_counts=True)
                keep = n >= CROWDED_IN_PIECE
                yield pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(n[keep])], ["bucket", "n"])

    counted = docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.array([r["bucket"] for r in counted.where(F.col("n") >= CROWDED).toLocalIterator()], np.int64).view(np.uint64)


def settle_runs(crowded: np.ndarray) -> Callable:
    """Over rows sorted by (bucket, name, doc, at): repeats and, from buckets with several texts, first runs."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, name, doc and at of the last text's first row
        waiting = None  # the first row of the last bucket while it has only one text

        for b in batches:
            bucket, name, doc, at = (b.column(c).to_numpy() for c in ("bucket", "name", "doc", "at"))
            settled = b.column("settled").to_numpy(zero_copy_only=False)
            out = [(doc[settled], at[settled], np.zeros(settled.sum(), bool))]
            bucket, name, doc, at = (x[~settled] for x in (bucket, name, doc, at))
            if not len(bucket):
                yield _flagged(out)
                continue
            before = last or (~bucket[0], ~name[0], doc[0], at[0])
            new_bucket = bucket != np.concatenate(([before[0]], bucket[:-1]))
            new_text = new_bucket | (name != np.concatenate(([before[1]], name[:-1])))
            heads = np.flatnonzero(new_text)
            head = np.cumsum(new_text) - 1
            head_doc, head_at = (np.where(head < 0, old, x[heads][np.maximum(head, 0)] if len(heads) else old) for old, x in ((before[2], doc), (before[3], at)))
            again = ~new_text & ((doc != head_doc) | (at != head_at))
            out.append((doc[again], at[again], np.zeros(again.sum(), bool)))
            further = new_text & ~new_bucket
            group = np.cumsum(new_bucket)  # 0: the bucket that the last batch ended in
            several = np.bincount(group, further) > 0
            fine = new_text & (several[group] | np.isin(bucket.view(np.uint64), crowded))
            if several[0] and waiting:
                out.append((np.array([waiting[0]]), np.array([waiting[1]]), np.ones(1, bool)))
                waiting = None
            out.append((doc[fine], at[fine], np.ones(fine.sum(), bool)))
            if new_bucket.any():
                start = int(np.flatnonzero(new_bucket)[-1])
                waiting = None if fine[start] else (doc[start], at[start])
            last = (bucket[-1], name[-1], head_doc[-1], head_at[-1])
            yield _flagged(out)

    return settle


def _flagged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    doc, at, fine = map(np.concatenate, zip(*parts))
    offset = at & ((1 << (OFFSET_BITS + SPAN_BITS)) - 1)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at >> (OFFSET_BITS + SPAN_BITS)), pa.array(offset << 1 | fine)], ["doc", "mark", "run"])


def _of_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of the elements of a list column."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()


def _from(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (count of them) for each entry."""
    return np.arange(count.sum()) + np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count)


def merged_ranges(doc: np.ndarray, mark: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of bytes that touch or overlap, joined within each document."""
    order = np.lexsort((begin, mark, doc))
    doc, mark, begin, end = doc[order], mark[order], begin[order], end[order]
    change = np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))[: len(doc)]
    group = np.cumsum(change) << 32  # keeps the running maximum of ends inside a document
    upto = np.maximum.accumulate(group + end) if len(end) else end
    first = np.flatnonzero(change | np.concatenate(([True], group[1:] + begin[1:] > upto[:-1]))[: len(doc)])
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return doc[first], mark[first], begin[first], (upto - group)[last]


def single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents with their flagged runs: the strings of first runs with their names, and repeats as they are.

    Rows: deal and name are the string's name; a settled row is a range of repeats, with its end in name.
    """
    for b in batches:
        data, bounds = text_bytes(b.column("text"))
        doc, mark = b.column("doc").to_numpy(), b.column("mark").to_numpy()
        row, packed = _of_lists(b.column("runs"))
        fine, run = (packed & 1).astype(bool), packed >> 1
        begin, count = run >> SPAN_BITS, (run & ((1 << SPAN_BITS) - 1)) + 1
        done, ends = [(doc[row[~fine]], place(mark[row[~fine]], begin[~fine]))], [begin[~fine] + count[~fine] - 1 + LENGTH]
        order = np.argsort(row[fine], kind="stable")
        row, begin, count = row[fine][order], begin[fine][order], count[fine][order]
        names: list[tuple[np.ndarray, ...]] = []
        for first, last in spans_of_rows(bounds, PIECE):
            mine = slice(*np.searchsorted(row, (first, last)))
            if mine.start == mine.stop:
                continue
            own = np.repeat(row[mine], count[mine])
            offset = _from(begin[mine], count[mine])
            # A long text is read from piece to piece, so that no array grows with it.
            low = int(bounds[first])
            absolute = bounds[own] + offset
            for piece in range(low, int(bounds[last]), 4 * PIECE):
                here = (absolute >= piece) & (absolute < piece + 4 * PIECE)
                if here.any():
                    eight = first_buckets(data[piece : min(piece + 4 * PIECE + LENGTH, int(bounds[last]))])
                    a, c = string_names(eight, absolute[here] - piece)
                    names.append((a, c, doc[own[here]], place(mark[own[here]], offset[here])))
        if names:
            a, c, d, at = map(np.concatenate, zip(*names))
            order, again = repeats((a, c), d, at)
            a, c, d, at = a[order], c[order], d[order], at[order]
            done.append((d[again], at[again]))
            ends.append((at[again] >> SPAN_BITS & ((1 << OFFSET_BITS) - 1)) + LENGTH)
            a, c, d, at = (x[~again] for x in (a, c, d, at))
        else:
            a, c, d, at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        done_doc, done_at = map(np.concatenate, zip(*done))
        offset = done_at >> SPAN_BITS & ((1 << OFFSET_BITS) - 1)
        done_doc, done_mark, offset, end = merged_ranges(done_doc, done_at >> (OFFSET_BITS + SPAN_BITS), offset, np.concatenate(ends))
        done_at = place(done_mark, offset)
        short = (c >> np.uint64(32)).astype(np.uint32).view(np.int32)  # 96 bits of the name are enough to meet by
        columns = [np.concatenate((a.view(np.int64), refine(done_doc.view(np.uint64), done_at.view(np.uint64)).view(np.int64))), np.concatenate((short, end.astype(np.int32))),
                   np.concatenate((d, done_doc)), np.concatenate((at, done_at)), np.concatenate((np.zeros(len(a), bool), np.ones(len(end), bool)))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["deal", "name", "doc", "at", "settled"])


def settle_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (deal, name, doc, at): removed ranges of bytes (doc, mark, begin, end)."""
    last = None
    for b in batches:
        deal, name, doc, at = (b.column(c).to_numpy() for c in ("deal", "name", "doc", "at"))
        settled = b.column("settled").to_numpy(zero_copy_only=False)
        own = ~settled
        k, n, d, p = deal[own], name[own], doc[own], at[own]
        if len(k):
            before = last or (~k[0], ~n[0], d[0], p[0])
            new = (k != np.concatenate(([before[0]], k[:-1]))) | (n != np.concatenate(([before[1]], n[:-1])))
            head, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            head_d, head_p = (np.where(head < 0, old, x[heads][np.maximum(head, 0)] if len(heads) else old) for old, x in ((before[2], d), (before[3], p)))
            again = ~new & ((d != head_d) | (p != head_p))
            last = (k[-1], n[-1], head_d[-1], head_p[-1])
        else:
            again = np.zeros(0, bool)
        out_doc, out_at = np.concatenate((d[again], doc[settled])), np.concatenate((p[again], at[settled]))
        begin = out_at >> SPAN_BITS & ((1 << OFFSET_BITS) - 1)
        end = np.concatenate((begin[: again.sum()] + LENGTH, name[settled].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(out_doc), pa.array(out_at >> (OFFSET_BITS + SPAN_BITS)), pa.array(begin << 31 | (end - begin))], ["doc", "mark", "cut"])


def text_numbers(rows: DataFrame) -> DataFrame:
    """rows: doc and full_mark. of_doc, of_mark and number: the place of each different text among those of its doc, for
    docs with several rows. Texts are counted by the upper bits of their marks first, so that no doc is one task."""
    repeated = rows.groupBy("doc").count().where("count > 1").select("doc")
    texts = rows.join(repeated, "doc", "left_semi").distinct().withColumn("part", F.shiftright("full_mark", 64 - PART_BITS))
    texts = materialize(texts, "repeated-ids")
    parts = texts.groupBy("doc", "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("doc").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))  # at most 2^PART_BITS rows
    within = F.row_number().over(W.partitionBy("doc", "part").orderBy("full_mark"))
    number = F.col("before") + F.col("within") - 1
    fits = F.when(number < 1 << MARK_BITS, number).otherwise(F.raise_error(F.lit(f"more than 2^{MARK_BITS} different texts have one doc_id")).cast("long"))
    both = texts.withColumn("within", within).join(parts.select("doc", "part", (upto - F.col("n")).alias("before")), ["doc", "part"])
    return materialize(both.select(F.col("doc").alias("of_doc"), F.col("full_mark").alias("of_mark"), fits.alias("number")), "text-numbers")


def keyed(docs: DataFrame) -> DataFrame:
    """doc (null last), mark (a number that tells apart texts of an id that is repeated, else 0), doc_id and text."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(LAST_ID)).alias("doc"), text_mark(F.col("text")).alias("full_mark"), doc_id.alias("doc_id"), "text")
    numbers = text_numbers(rows.select("doc", "full_mark"))
    same = (F.col("doc") == F.col("of_doc")) & (F.col("full_mark") == F.col("of_mark"))
    return rows.join(numbers, same, "left").select("doc", F.coalesce("number", F.lit(0)).cast("long").alias("mark"), "doc_id", "text")


def removed_ranges(rows: DataFrame) -> DataFrame:
    """rows: see ``keyed``. doc, mark and cuts (begin << 31 | length) of every document that loses something."""
    rows = rows.select("doc", "mark", "text")
    crowded = crowded_buckets(rows)
    dealt = run_rows(rows, crowded).repartition("bucket", "salt").sortWithinPartitions("bucket", "name", "doc", "at")
    flagged = dealt.mapInArrow(settle_runs(crowded), "doc long, mark long, run long")
    flagged = materialize(flagged.groupBy("doc", "mark").agg(F.collect_list("run").alias("runs")), "flagged-runs")
    strings = rows.join(flagged, ["doc", "mark"]).mapInArrow(single_strings, "deal long, name int, doc long, at long, settled boolean")
    cuts = strings.repartition("deal").sortWithinPartitions("deal", "name", "doc", "at").mapInArrow(settle_strings, "doc long, mark long, cut long")
    return materialize(cuts.groupBy("doc", "mark").agg(F.collect_list("cut").alias("cuts")), "cuts")


def kept_runs(n: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of a text of n bytes from overlapping ranges, by first byte and end."""
    order = np.argsort(begin, kind="stable")
    begin, upto = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.concatenate(([True], begin[1:] > upto[:-1])) if len(begin) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return begin[first], upto[np.append(first[1:], len(begin)) - 1] if len(first) else upto


def _apply(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = text_bytes(b.column("text"))
        row, cut = _of_lists(b.column("cuts"))
        where = np.searchsorted(row, np.arange(b.num_rows + 1))
        out = []
        for i in range(b.num_rows):
            own = cut[where[i] : where[i + 1]]
            text = data[bounds[i] : bounds[i + 1]]
            begin, end = kept_runs(len(text), own >> 31, (own >> 31) + (own & ((1 << 31) - 1)))
            digest, at, kept = hashlib.sha256(), 0, []
            for s, e in [*zip(begin.tolist(), end.tolist()), (len(text), len(text))]:
                digest.update(text[at:s])
                if with_text:
                    kept.append(text[at:s].tobytes())
                at = e
            out.append((len(text), int((end - begin).sum()), len(begin), digest.hexdigest(), *([b"".join(kept)] if with_text else [])))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array([o[k] for o in out], kinds[k]) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *names])


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``; and, if asked for, the kept bytes
    (a cut may fall inside a character, so they are binary)."""
    rows = keyed(docs)
    joined = rows.join(removed_ranges(rows), ["doc", "mark"], "left").select("doc_id", "text", "cuts")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return joined.mapInArrow(lambda batches: _apply(batches, with_text), schema)

"""Near copies by the similarity of word shingles: near fingerprints and min-hash bands as candidates, exact Jaccard as the rule.

Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more; one
document of each component of links stays. Candidates share one of ``BANDS`` keys of ``ROWS`` min-hashes; a pair at
similarity 0.8 shares none with a chance of about 3 in a million. No pair that shares a key is left out, unless other
links connect it already:

* First the bit-sliced comparison of ``simhash`` links near fingerprints, and of a few bands every document is compared with
  two members of its bucket. That connects most copies.
* Then all bands are used. Of a bucket with up to ``SMALL`` members every pair that is not connected is compared.
* A larger bucket is dealt into blocks (at most about ``BLOCK`` sets and ``BLOCK_HASHES`` shingles) by class of size and,
  for components that fill blocks, by component. Two blocks meet in a task of their own, unless their sizes are too
  different or both belong to one component. The task counts common shingles for all pairs at once and returns a
  spanning forest of its links, so pairs are never rows. The work of a bucket grows with the square of what is in it and
  not yet connected; its memory does not grow.

Documents with one set of shingles are one node, so exact copies do not meet at all. Sets are built a second time for the
documents that have candidates, instead of being kept for all.

Defined results: null text counts as empty; a text of fewer than five words has one shingle, all its words; documents
without words are one group; words are lowered by ASCII and split at the six ASCII blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.llm import simhash
from trackloom.llm.common import fresh, same_row, spans_of_rows, text_bytes, text_mark
from trackloom.llm.components import components
from trackloom.session import materialize

SHINGLE, SEED = 5, 42
SIMILARITY = (4, 5)  # as a fraction, so that the rule is one of whole numbers
BANDS, ROWS, FIRST_BANDS = 32, 5, 4
TOGETHER = 4096
SMALL, BLOCK, BLOCK_HASHES = 8, 256, 1 << 18

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's shingles."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last.tolist())), np.uint64, len(last)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band from the least of the hashes under BANDS * ROWS orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), TOGETHER):
        least = np.minimum(least, ((hashes[at : at + TOGETHER, None] ^ _FLIP) * _TIMES).min(axis=0))
    key = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * _MIX
        key ^= key >> np.uint64(31)
    return key


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark, node (names the set of shingles), size of the set, band keys and fingerprint (``simhash``) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column("text"))
            node, size, keys = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, BANDS), np.uint64)
            fp = np.zeros(b.num_rows, np.uint64)
            for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
                text = data[s:e].tobytes()
                hashes, fp[i] = shingles(text), simhash.fingerprint(text)
                node[i], size[i] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED), len(hashes)
                keys[i] = band_keys(hashes)
            of_bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(node.view(np.int64)), pa.array(size), of_bands, pa.array(fp.view(np.int64))], ["doc_id", "mark", "node", "size", "keys", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), "text")
    return rows.mapInArrow(compute, "doc_id long, mark long, node long, size long, keys array<long>, fp long")


def _in_bands(nodes: DataFrame, bands: int) -> DataFrame:
    return nodes.where("size > 0").select("node", "size", "root", F.posexplode(F.slice("keys", 1, bands)).alias("band", "key"))


def _alike_in_size(a: Column, b: Column) -> Column:
    """A set that is much smaller than the other cannot be similar."""
    part, whole = SIMILARITY
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def _ordered_pairs(met: DataFrame) -> DataFrame:
    """met: structs x and y of node, size and root."""
    met = met.where((F.col("x.root") != F.col("y.root")) & _alike_in_size(F.col("x.size"), F.col("y.size")))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def first_candidates(nodes: DataFrame, bands: int = FIRST_BANDS) -> DataFrame:
    """nodes: node, size, keys and root. Pairs a < b of every node with the two ends, in a drawn order, of its buckets."""
    rows, one = _in_bands(nodes, bands), F.struct("node", "size", "root")
    draw = F.xxhash64("node", "band")
    ends = rows.groupBy(F.col("band").alias("of_band"), F.col("key").alias("of_key")).agg(
        F.array(F.min_by(one, draw), F.max_by(one, draw)).alias("ends"), F.count("*").alias("n")).where("n > 1")
    met = rows.join(ends, (F.col("band") == F.col("of_band")) & (F.col("key") == F.col("of_key")))
    return _ordered_pairs(met.select(one.alias("x"), F.explode("ends").alias("y")))


def print_candidates(nodes: DataFrame) -> DataFrame:
    """nodes: node, size, fp and root. Pairs a < b that connect what ``simhash`` links by two bits or fewer: every node with
    the first one of its fingerprint, and the first ones along the links between fingerprints."""
    rows, one = nodes.where("size > 0"), F.struct("node", "size", "root")
    firsts = materialize(rows.groupBy("fp").agg(F.min(one).alias("x")), "prints")
    alike = rows.select("fp", one.alias("y")).join(firsts, "fp").select("x", "y")
    links = simhash.link_edges(simhash.grouped(firsts.select("fp")))
    end = lambda name, as_: firsts.select(F.col("fp").alias(name), F.col("x").alias(as_))
    return _ordered_pairs(alike.unionByName(links.join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")))


def open_buckets(nodes: DataFrame) -> DataFrame:
    """band, key, n (members), node, size and root of the buckets that hold more than one component."""
    rows = _in_bands(nodes, BANDS)
    mixed = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    return rows.join(mixed.where("least != most").select("band", "key", "n"), ["band", "key"])


def small_candidates(opened: DataFrame) -> DataFrame:
    """All pairs a < b that are not connected, of buckets with up to SMALL members."""
    bucket = opened.where(F.col("n") <= SMALL).groupBy("band", "key").agg(F.collect_list(F.struct("node", "size", "root")).alias("members"))
    return _ordered_pairs(bucket.select("members", F.explode("members").alias("x")).select("x", F.explode("members").alias("y")).where("x.node < y.node"))


def dealt_blocks(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of larger buckets: (bucket, block, node, root) and the blocks to compare (bucket, a, b) with a <= b.

    Sizes of similar sets lie in one class or in neighbouring ones. A component with BLOCK members or more in a class of
    a bucket has blocks of its own, which need not meet each other.
    """
    # A little more than 5/4, so that rounding cannot put sizes of that ratio two classes apart.
    level = F.floor(F.log("size") / F.lit(np.log(SIMILARITY[1] / SIMILARITY[0]) + 1e-7)).cast("int")
    rows = opened.where(F.col("n") > SMALL).select(F.xxhash64("band", "key").alias("bucket"), level.alias("level"), "node", "size", "root")
    roots = rows.groupBy("bucket", "level", "root").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"))
    roots = roots.withColumn("owner", F.when(F.col("n") >= BLOCK, F.col("root")))
    parts = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("hashes") / BLOCK_HASHES)).cast("int")
    owners = roots.groupBy(F.col("bucket").alias("of_bucket"), F.col("level").alias("of_level"), F.col("owner").alias("of_owner")).agg(parts.alias("parts"))
    number = lambda level, owner, part: F.xxhash64(level, owner.isNull(), owner, part)

    known = roots.join(owners, (F.col("bucket") == F.col("of_bucket")) & (F.col("level") == F.col("of_level")) & F.col("owner").eqNullSafe(F.col("of_owner")))
    block = number(F.col("level"), F.col("owner"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = rows.join(known.select("bucket", "level", "root", "owner", "parts"), ["bucket", "level", "root"]).select("bucket", block.alias("block"), "node", "root")

    blocks = owners.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.select(F.col("of_bucket").alias("bucket"), F.col("of_level").alias("level"), F.col("of_owner").alias("owner"), number(F.col("of_level"), F.col("of_owner"), F.col("part")).alias("block"))
    one, other = (blocks.select("bucket", F.struct("block", "level", "owner").alias(n)) for n in ("x", "y"))
    same_owner = F.coalesce(F.col("x.owner") == F.col("y.owner"), F.lit(False))
    met = one.join(other, "bucket").where((F.col("x.block") <= F.col("y.block")) & (F.abs(F.col("x.level") - F.col("y.level")) <= 1) & ~same_owner)
    return dealt, met.select("bucket", F.col("x.block").alias("a"), F.col("y.block").alias("b"))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: doc_id, mark and node. The node and the hashes of its set."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column("text"))
            for first, last in spans_of_rows(bounds):  # sets are larger than their texts: those of a whole batch are too many
                sets = [shingles(data[s:e].tobytes()).view(np.int64) for s, e in zip(bounds[first:last], bounds[first + 1 : last + 1])]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(first, last - first), _lists(sets)], ["node", "hashes"])

    own_id, own_mark, node = fresh(docs, "own_id", "own_mark", "own_node")
    found = docs.join(wanted.toDF(own_id, own_mark, node), same_row(docs, own_id, own_mark)).select(F.col(node).alias("node"), "text")
    # Rows equal in doc_id and text give one set several times.
    return found.mapInArrow(compute, "node long, hashes array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_hashes"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common, total = F.size(F.array_intersect("a_hashes", "b_hashes")), F.size("a_hashes") + F.size("b_hashes")
    part, whole = SIMILARITY
    return both.where(common * (part + whole) >= total * part).select("a", "b")


def _incidence(owner: np.ndarray, place: np.ndarray, rows: int, first: int, last: int) -> np.ndarray:
    out = np.zeros((rows, last - first), np.float32)
    here = (place >= first) & (place < last)
    out[owner[here], place[here] - first] = 1
    return out


def common_counts(ends_a: np.ndarray, hashes_a: np.ndarray, ends_b: np.ndarray, hashes_b: np.ndarray) -> np.ndarray:
    """Sets as their hashes one after the other and where each ends. How many hashes each set of a shares with each of b."""
    shared = np.intersect1d(hashes_a, hashes_b)
    sides = []
    for ends, hashes in ((ends_a, hashes_a), (ends_b, hashes_b)):
        place = np.searchsorted(shared, hashes)
        used = shared[np.minimum(place, len(shared) - 1)] == hashes if len(shared) else np.zeros(len(hashes), bool)
        sides.append((np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[used], place[used], len(ends)))
    out = np.zeros((len(ends_a), len(ends_b)), np.float32)  # whole numbers up to 2**24 in each part of the sum
    for first in range(0, len(shared), TOGETHER):
        left, right = (_incidence(*side, first, min(first + TOGETHER, len(shared))) for side in sides)
        out += left @ right.T
    return out.astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray, root_a: np.ndarray, root_b: np.ndarray) -> list[int]:
    """Which of the links (a[i], b[i]) join components that the links before them do not join."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(root_a[a].tolist(), root_b[b].tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            kept.append(i)
    return kept


def _links_of_blocks(rows: pa.Table) -> pa.Table:
    """The rows of two blocks (side 1 and 2, or 3 for a block with itself): node, root, hashes. Links a, b that connect."""
    side, sizes = rows.column("side").to_numpy(), []
    part, whole = SIMILARITY
    for bit in (1, 2):
        mine = rows.filter(pa.array((side & bit) > 0)).combine_chunks()
        lists = mine.column("hashes").combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        sizes.append((mine.column("node").to_numpy(), mine.column("root").to_numpy(), ends, lists.flatten().to_numpy(zero_copy_only=False)))
    (node_a, root_a, ends_a, hashes_a), (node_b, root_b, ends_b, hashes_b) = sizes
    common = common_counts(ends_a, hashes_a, ends_b, hashes_b)
    total = np.diff(ends_a, prepend=0)[:, None] + np.diff(ends_b, prepend=0)[None, :]
    a, b = np.nonzero((common * (part + whole) >= total * part) & (root_a[:, None] != root_b[None, :]))
    kept = forest(a, b, root_a, root_b)
    return pa.table({"a": pa.array(node_a[a[kept]], pa.int64()), "b": pa.array(node_b[b[kept]], pa.int64())})


def block_links(dealt: DataFrame, met: DataFrame, sets: DataFrame) -> DataFrame:
    """dealt, met: as ``dealt_blocks`` gives them. Links (a, b) that connect what all pairs of similar sets connect."""
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(3).alias("side")))).otherwise(
        F.array(F.struct(F.col("a").alias("block"), F.lit(1).alias("side")), F.struct(F.col("b").alias("block"), F.lit(2).alias("side"))))
    sides = met.select("bucket", F.col("a").alias("left"), F.col("b").alias("right"), F.inline(both))
    rows = dealt.join(sides, ["bucket", "block"]).join(sets, "node").select("bucket", "left", "right", "side", "node", "root", "hashes")
    return rows.groupBy("bucket", "left", "right").applyInArrow(_links_of_blocks, "a long, b long")


def members(docs: DataFrame) -> DataFrame:
    """doc_id, mark and group (a node that names the component) of every row of ``docs``."""
    rows = materialize(signatures(docs), "shingle-signatures")
    nodes = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "size", "keys", "fp")).alias("first"))
    nodes = materialize(nodes.select("node", "first.doc_id", "first.mark", "first.size", "first.keys", "first.fp"), "shingle-nodes")

    def sets_of(compared: DataFrame) -> DataFrame:
        return materialize(shingle_sets(docs, nodes.join(compared.distinct(), "node", "left_semi").select("doc_id", "mark", "node")), "shingle-sets")

    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    apart = nodes.withColumn("root", F.col("node"))
    pairs = materialize(print_candidates(apart).union(first_candidates(apart)).distinct(), "candidates")
    early = materialize(similar(pairs, sets_of(ends(pairs))), "links")
    rooted = nodes.join(components(early).toDF("of", "root"), F.col("node") == F.col("of"), "left").drop("of")
    opened = materialize(open_buckets(rooted.withColumn("root", F.coalesce("root", "node"))), "open-buckets")

    pairs = materialize(small_candidates(opened), "candidates")
    dealt, met = dealt_blocks(opened)
    dealt = materialize(dealt, "blocks")
    sets = sets_of(ends(pairs).union(dealt.select("node")))
    late = materialize(similar(pairs, sets).union(block_links(dealt, met, sets)), "links")
    linked = components(early.union(late))
    return rows.join(linked.toDF("of", "root"), F.col("node") == F.col("of"), "left").select("doc_id", "mark", F.coalesce("root", "node").alias("group"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the smallest doc_id (then text mark), and one of equal rows."""
    return simhash.keep_first(docs, materialize(members(docs), "members"))

"""Trie of conversations: a node for each distinct sequence of first turns, with counts over its subtree.

A turn is named by 128 bits of its role and text, so the rows that are moved are narrow. Conversations with one sequence of
turns become one row first. The sequences are sorted by range, and each range is cut into blocks, read as a matrix of turn
numbers padded with -1: ``lexsort`` orders its rows, the columns where a row differs from the one before, accumulated by OR,
mark where nodes start, and ``reduceat`` adds up every depth. All counts of a node are sums over its rows, as a row adds what
starts with it: the words of its new nodes, its new children, itself as a leaf.

A node that other blocks may share lies on the way to the first or the last row of a block. Such boundary nodes are few (twice
the depth of a block) and are combined afterwards; what a later block has counted anew is known from the deepest node of its
first row that an earlier block has too, and is taken back from the nodes above it in closed form. A last row that turns out
to have children in the next block is taken back as a leaf in the same way.

Work of one task: rows of a block up to ``CELLS`` padded turns, or one conversation. Ids of the members of one sequence are
sorted by Spark and hashed as they stream by.

Defined results: turns are in the order of turn (null first), then role, then the md5 of role and text; null role or text
counts as empty; repeated rows are turns of their own; rows without conv_id belong to no conversation. c % 20 keeps the sign
of c. An empty table has no conversations and so no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.common import blank_words
from trackloom.session import materialize

FAMILY, HEADS = 20, 4  # conversations that share a first one; how many of its turns they take is below HEADS
CELLS = 1_000_000  # turns of a block, padding included
NAME = 16  # bytes that name a turn
NO_ENDS = hashlib.sha256().hexdigest()
NODE = """depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, all_words long, own_words long,
  ends_sha256 string, key binary, parent_key binary, block long, on_first boolean, on_last boolean, is_last boolean, words_before long, words_here long"""
SCHEMA = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind])
                    for name, kind in (column.split() for column in NODE.split(","))])


def named_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, name (hex digits) and words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role keeps a role and text apart from another split of the same letters.
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), name.alias("name"), blank_words(text).alias("words"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (the names of its turns, one after another) and words (of each turn) of every conversation.

    The first turns come from the conversation that its family of FAMILY ids starts with.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "name", "words")))
    own = named_turns(conversations).groupBy("conv_id").agg(turns.alias("turns"))
    own = own.select("conv_id", F.transform("turns", lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words"))).alias("turns"))
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, HEADS - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("head_id"), "left")
    # As many turns as the head gives or has, then the conversation's own beyond the number asked for.
    head = F.coalesce(F.slice("head", F.lit(1), taken), F.slice("turns", F.lit(1), F.lit(0)))
    rest = F.slice("turns", taken + 1, F.greatest(F.size("turns"), F.lit(1)))
    whole = joined.select("conv_id", F.concat(head, rest).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join("turns.name", "")).alias("path"), F.col("turns.words").alias("words"))


def sequences(conversations: DataFrame) -> DataFrame:
    """path, words, n (conversations with this sequence of turns), least (their smallest id) and ends_sha256 (of their ids).

    conversations: as ``rebuilt`` gives them. Equal paths meet sorted by id, and a task keeps nothing of them but a hash.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "words", "n", "least", "ends_sha256"]
        open_group = None
        for b in batches:
            done = []
            for path, words, conv in zip(*(b.column(c).to_pylist() for c in ("path", "words", "conv_id"))):
                if open_group is None or open_group[0] != path:
                    if open_group is not None:
                        done.append(open_group)
                    open_group = [path, words, 0, conv, hashlib.sha256()]
                open_group[4].update(f",{conv}".encode() if open_group[2] else str(conv).encode())
                open_group[2] += 1
            if done:
                yield closed(done, names)
        if open_group is not None:
            yield closed([open_group], names)

    def closed(groups: list[list], names: list[str]) -> pa.RecordBatch:
        path, words, n, least, ends = zip(*groups)
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
        columns = (path, words, n, least, [e.hexdigest() for e in ends])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = conversations.repartition("path").sortWithinPartitions("path", "conv_id")
    return rows.mapInArrow(hashed, "path binary, words array<long>, n long, least long, ends_sha256 string")


def _turn_numbers(paths: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The turns of each path as numbers in the order of their names, padded with -1."""
    halves = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.ones(len(order), np.int64)
    new[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(new) - 1
    return _padded(numbers, sizes, -1)


def _padded(values: np.ndarray, sizes: np.ndarray, empty: int) -> np.ndarray:
    out = np.full((len(sizes), int(sizes.max(initial=0))), empty, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _from_the_right(values: np.ndarray) -> np.ndarray:
    """Sums of each row from each column on, and a column of zeros behind the last."""
    out = np.zeros((values.shape[0], values.shape[1] + 1), np.int64)
    out[:, :-1] = np.cumsum(values[:, ::-1], axis=1)[:, ::-1]
    return out


def _keys(path: bytes) -> list[bytes]:
    """Names of the nodes on the way to a path, from the root."""
    so_far = hashlib.md5()
    out = [so_far.digest()]
    for at in range(0, len(path), NAME):
        so_far.update(path[at : at + NAME])
        out.append(so_far.digest())
    return out


def block_nodes(rows: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
    """Nodes of consecutive sequences (path, words, n, least, ends_sha256), as far as these rows tell."""
    sizes = np.array([len(r[0]) // NAME for r in rows])
    turns = _turn_numbers([r[0] for r in rows], sizes)
    order = np.lexsort(turns.T[::-1]) if turns.shape[1] else np.arange(len(rows))
    turns, sizes, rows = turns[order], sizes[order], [rows[i] for i in order]
    words = _padded(np.array([w for r in rows for w in r[1]], np.int64), sizes, 0)
    n, least = (np.array([r[i] for r in rows], np.int64) for i in (2, 3))
    many, deepest = len(rows), turns.shape[1]

    differs = np.ones(turns.shape, bool)
    differs[1:] = turns[1:] != turns[:-1]
    differs = np.logical_or.accumulate(differs, axis=1)
    starts = differs & (turns >= 0)  # a node begins here
    leaf = np.ones(many, np.int64)  # unless the next row continues this one
    inside = sizes[:-1] > 0
    leaf[:-1] = np.where(inside, differs[1:][np.arange(many - 1), np.maximum(sizes[:-1] - 1, 0)] if deepest else False, False)
    every, own = _from_the_right(words) * n[:, None], _from_the_right(words * starts)
    first, last = _keys(rows[0][0]), _keys(rows[-1][0])
    first_words = np.concatenate(([0], np.cumsum(words[0])))

    parent_least = parent_segment = None
    for depth in range(deepest + 1):
        edge = np.flatnonzero(differs[:, depth - 1]) if depth else np.zeros(1, np.int64)
        segment = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, many)))
        of_least = np.minimum.reduceat(least, edge)
        kept = np.flatnonzero(sizes[edge] >= depth)
        at = edge[kept]
        total = lambda values: np.add.reduceat(values, edge)[kept]
        column = max(depth - 1, 0)
        children = starts[:, depth].astype(np.int64) if depth < deepest else np.zeros(many, np.int64)
        on_first = kept == 0 if sizes[0] >= depth else np.zeros(len(kept), bool)
        on_last = kept == len(edge) - 1 if sizes[-1] >= depth else np.zeros(len(kept), bool)
        shared = [first[depth] if f else last[depth] if e else None for f, e in zip(on_first.tolist(), on_last.tolist())]
        parents, parent_keys = [None] * len(kept), [None] * len(kept)
        if depth:
            above = parent_segment[at]
            parents = parent_least[above].tolist()
            for k, p in enumerate(above.tolist()):
                if p == 0 and sizes[0] >= depth - 1:
                    parents[k], parent_keys[k] = None, first[depth - 1]
                elif p == parent_segment[-1] and sizes[-1] >= depth - 1:
                    parents[k], parent_keys[k] = None, last[depth - 1]
        ends = [rows[i][4] if sizes[i] == depth else NO_ENDS for i in at.tolist()]
        before, here = (first_words[max(depth - 1, 0)], first_words[depth]) if depth <= sizes[0] else (0, 0)
        out = [
            np.full(len(kept), depth), of_least[kept], parents, total(n), total(children), total(leaf), total(every[:, column]), total(own[:, column]),
            ends, shared, parent_keys, np.full(len(kept), block), on_first, on_last, on_last & (sizes[-1] == depth),
            np.full(len(kept), before), np.full(len(kept), here)]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, SCHEMA)], schema=SCHEMA)
        parent_least, parent_segment = of_least, segment


def partial_nodes(distinct: DataFrame) -> DataFrame:
    """NODE columns for every node of every block of ``sequences``; a key stands in those that other blocks may share."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Partitions of a range partitioning are in order, and so are the blocks of a partition.
        block = TaskContext.get().partitionId() << 32
        held, widest, out = [], 1, []

        def done(more: int = 10_000) -> Iterator[pa.RecordBatch]:
            """A batch for each depth of each block would be many small ones."""
            if sum(b.num_rows for b in out) >= more or len(out) >= more:
                yield from pa.Table.from_batches(out, SCHEMA).combine_chunks().to_batches()
                out.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("path", "words", "n", "least", "ends_sha256"))):
                width = max(widest, len(row[0]) // NAME)
                if held and (len(held) + 1) * width > CELLS:
                    for nodes in block_nodes(held, block):
                        out.append(nodes)
                        yield from done()
                    held, width, block = [], max(1, len(row[0]) // NAME), block + 1
                held.append(row)
                widest = width
        if held:
            for nodes in block_nodes(held, block):
                out.append(nodes)
                yield from done()
        yield from done(0)

    return distinct.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(blocks, NODE)


def combined(shared: DataFrame) -> DataFrame:
    """One row for each key of the boundary nodes, with nothing counted twice."""
    earliest = shared.groupBy(F.col("key").alias("of")).agg(F.min("block").alias("earliest"))
    rows = shared.join(earliest, F.col("key") == F.col("of")).drop("of")
    # Nodes of a block's first row that an earlier block has: new to the block, but not new.
    seen = rows.where("on_first AND depth > 0 AND block > earliest").groupBy(F.col("block").alias("of")).agg(
        F.max("depth").alias("seen_depth"), F.max("words_here").alias("seen_words"))
    rows = rows.join(seen, F.col("block") == F.col("of"), "left").drop("of")
    again = F.col("on_first") & (F.col("depth") <= F.col("seen_depth"))
    rows = rows.withColumn("own_words", F.col("own_words") - F.when(again, F.col("seen_words") - F.col("words_before")).otherwise(0))
    rows = rows.withColumn("n_children", F.col("n_children") - F.when(again & (F.col("depth") < F.col("seen_depth")), 1).otherwise(0))
    # The last row of a block is no leaf if its node has children elsewhere.
    continued = rows.groupBy(F.col("key").alias("of")).agg(F.sum("n_children").alias("of_children")).where("of_children > 0")
    continued = rows.where("is_last").join(continued, F.col("key") == F.col("of"), "left_semi").select(F.col("block").alias("of")).distinct()
    rows = rows.join(continued, F.col("block") == F.col("of"), "left")
    rows = rows.withColumn("n_leaves", F.col("n_leaves") - F.when(F.col("on_last") & F.col("of").isNotNull(), 1).otherwise(0))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "all_words", "own_words")]
    ends = F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends_sha256")
    return rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), ends, *sums)


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256."""
    nodes = materialize(partial_nodes(sequences(rebuilt(conversations))), "trie-nodes")
    edge = materialize(combined(nodes.where("key IS NOT NULL")), "trie-edge-nodes")
    above = edge.select(F.col("key").alias("of"), F.col("conv_id").alias("above_id"))
    shown = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", (F.col("all_words") - F.col("own_words")).alias("saved_tokens"), "ends_sha256"]
    inner = nodes.where("key IS NULL")
    settled = inner.where("parent_key IS NULL").select(*shown, "parent_conv_id")
    below = inner.where("parent_key IS NOT NULL").select("parent_key", *shown).union(edge.select("parent_key", *shown))
    below = below.join(above, F.col("parent_key") == F.col("of"), "left").select(*below.columns[1:], F.col("above_id").alias("parent_conv_id"))
    every = settled.union(below)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

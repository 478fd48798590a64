"""Approximate nearest neighbours (largest inner product) by a hierarchical k-means tree.

The tree is fitted on a bounded sample of ``SAMPLE`` vectors; every vector is then indexed by descending to its nearest
centre. A query walks the tree best bin first: a priority queue holds the unopened nodes by the inner product with their
centre, leaves are visited in that order, and the number of visited leaves is widened until the recall of ``CALIBRATION``
sampled queries, measured against all vectors, reaches ``RECALL`` (and until the visited leaves hold enough vectors).

Members and visitors of a leaf meet in tiles of at most about ``TILE`` by ``TILE`` vectors, so neither a leaf that holds a
third of all vectors nor one that every query visits is one task. A tile gives each of its queries the best k at most.
Sums are taken in double precision in a fixed order, so that equal vectors have equal scores; ties go to the smaller id.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id
or with another length than the most frequent one (the smaller among equally frequent), which have no inner product with
the others. Rows that repeat an id, or are equal, are candidates and queries of their own: only the query's own row is
left out of its search, so an id can be its own neighbour, and a repeated query id has a list for each of its rows. With
fewer than k candidates all are returned; with none, there is no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trackloom.session import materialize

SAMPLE = 20_000
BRANCHES = 8
LEAF_SAMPLE = 500
CALIBRATION = 100
RECALL = 0.95
NEIGHBOURS = 20
QUERY_STEP = 20
TILE = 2048
ROUNDS = 12


def taking_part(vectors: DataFrame) -> DataFrame:
    """row (its number), vec_id and v (doubles) of the vectors that can be searched."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    good = materialize(good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")  # numbers stay as written
    lengths = good.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    return good.where(F.size("v") == lengths[0]["length"]) if lengths else good


@dataclass
class Node:
    centre: np.ndarray
    leaf: int = -1
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (0.5 * (centres**2).sum(axis=1) - x @ centres.T).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centres (non-empty ones) and each row's centre."""
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    own = _nearest(x, centres)
    for _ in range(rounds):
        used, own = np.unique(own, return_inverse=True)
        centres = np.stack([x[own == i].mean(axis=0) for i in range(len(used))])
        new = _nearest(x, centres)
        if (new == own).all():
            break
        own = new
    used, own = np.unique(own, return_inverse=True)
    return centres[used], own


class Tree:
    """Fitted on a sample; ``leaves`` nodes of it are leaves, numbered from 0."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, seed: int = 11):
        self.leaves, rng = 0, np.random.default_rng(seed)

        def grow(x: np.ndarray) -> Node:
            node = Node(x.mean(axis=0))
            if len(x) > leaf_sample:
                centres, own = k_means(x, branches, rng)
                if len(centres) > 1:
                    node.children = [grow(x[own == i]) for i in range(len(centres))]
                    node.centres = np.stack([c.centre for c in node.children])
                    return node
            node.leaf = self.leaves
            self.leaves += 1
            return node

        self.root = grow(sample)

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)

        def down(node: Node, rows: np.ndarray) -> None:
            if not node.children:
                out[rows] = node.leaf
                return
            own = _nearest(x[rows], node.centres)
            for i, child in enumerate(node.children):
                if len(part := rows[own == i]):
                    down(child, part)

        down(self.root, np.arange(len(x)))
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue, count = [(0.0, 0, self.root)], 1
        while queue:
            _, _, node = heapq.heappop(queue)
            while node.children:
                near = node.centres @ query
                best = int(near.argmax())
                for i, child in enumerate(node.children):
                    if i != best:
                        heapq.heappush(queue, (-float(near[i]), count, child))
                        count += 1
                node = node.children[best]
            yield node.leaf


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def best_of(queries: np.ndarray, query_rows: np.ndarray, members: np.ndarray, member_rows: np.ndarray, member_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best k of ``members`` without its own row, ties to the smaller id: places of query and member, scores."""
    owner, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    rough = queries @ members.T
    rough[query_rows[:, None] == member_rows[None, :]] = -np.inf
    for i, row in enumerate(rough):
        if len(row) > k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            # The product's rounding depends on where a vector lies in the block; the sums below decide.
            at = np.flatnonzero(row >= edge - 1e-9 * (1 + abs(edge))) if np.isfinite(edge) else np.flatnonzero(np.isfinite(row))
        else:
            at = np.flatnonzero(np.isfinite(row))
        score = (members[at] * queries[i]).sum(axis=1)
        order = np.lexsort((member_rows[at], member_ids[at], -score))[:k]
        owner.append(np.full(len(order), i))
        found.append(at[order])
        scores.append(score[order])
    return np.concatenate(owner), np.concatenate(found), np.concatenate(scores)


def index(vectors: DataFrame, tree: Tree, width: int) -> DataFrame:
    """vectors with their leaf, written."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)  # SAMPLE / LEAF_SAMPLE leaves or so, whatever is indexed

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(shared.value.assign(matrix(b.column("v"), width)), pa.int32())], ["row", "vec_id", "v", "leaf"])

    return materialize(vectors.mapInArrow(leaf, "row long, vec_id long, v array<double>, leaf int"), "leaves")


def calibrate(indexed: DataFrame, tree: Tree, width: int, k: int, target: float = RECALL, count: int = CALIBRATION) -> int:
    """Leaves to visit so that ``count`` sampled queries find ``target`` of their true neighbours among all vectors."""
    picked = indexed.where(F.col("vec_id") % QUERY_STEP == 0).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(count).collect()
    if not picked:
        return 1
    own_rows, q = np.array([r["row"] for r in picked]), np.array([r["v"] for r in picked])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids, rows, leaf = matrix(b.column("v"), width), *(b.column(c).to_numpy() for c in ("vec_id", "row", "leaf"))
            for at in range(0, len(x), TILE):
                part = slice(at, at + TILE)
                owner, found, score = best_of(q, own_rows, x[part], rows[part], ids[part], k)
                yield pa.RecordBatch.from_arrays([pa.array(own_rows[owner], pa.int64()), pa.array(rows[part][found], pa.int64()), pa.array(ids[part][found], pa.int64()), pa.array(score), pa.array(leaf[part][found], pa.int32())], ["query_row", "row", "vec_id", "score", "leaf"])

    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    exact = indexed.mapInArrow(search, "query_row long, row long, vec_id long, score double, leaf int")
    rows = exact.withColumn("i", F.row_number().over(ranked)).where(F.col("i") <= k).select("query_row", "leaf").collect()  # count * k rows
    place = {int(i): {leaf: n for n, leaf in enumerate(tree.visits(v))} for i, v in zip(own_rows, q)}
    needed = np.sort([place[r["query_row"]][r["leaf"]] + 1 for r in rows])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else 1


def search(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, sample: int = SAMPLE, target: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every vector whose id is divisible by ``step``."""
    good = taking_part(vectors)
    fitted = good.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toPandas()
    if not len(fitted):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.stack(fitted["v"].to_numpy())
    width, tree = x.shape[1], Tree(x)
    indexed = index(good, tree, width)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row for each leaf
        sizes[r["leaf"]] = r["count"]
    widen = calibrate(indexed, tree, width, k, target)
    shared = indexed.sparkSession.sparkContext.broadcast((tree, sizes))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sizes = shared.value
        for b in batches:
            row, leaf = [], []
            for i, q in enumerate(matrix(b.column("v"), width) if b.num_rows else ()):
                seen = 0
                for n, at in enumerate(tree.visits(q)):
                    if n >= widen and seen > k:
                        break
                    seen += sizes[at]
                    if sizes[at]:
                        row.append(i)
                        leaf.append(at)
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(of), b.column("vec_id").take(of), b.column("v").take(of), pa.array(leaf, pa.int32())], ["query_row", "query_id", "q", "leaf"])

    queries = materialize(indexed.where(F.col("vec_id") % step == 0).select("row", "vec_id", "v").mapInArrow(walk, "query_row long, query_id long, q array<double>, leaf int"), "visits")
    visitors = np.zeros(tree.leaves, np.int64)
    for r in queries.groupBy("leaf").count().collect():
        visitors[r["leaf"]] = r["count"]
    tiles = lambda counts: F.element_at(F.lit([int(max(1, -(-c // TILE))) for c in counts]), F.col("leaf") + 1)
    spread = lambda df, key, own, own_counts, other, other_counts: df.withColumn(
        own, F.pmod(F.xxhash64(key), tiles(own_counts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), tiles(other_counts) - 1)))
    left = spread(indexed.where(F.element_at(F.lit([bool(c) for c in visitors]), F.col("leaf") + 1)), "row", "m", sizes, "q_tile", visitors)
    right = spread(queries, "query_row", "q_tile", visitors, "m", sizes)

    def compare(members: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
        vectors = lambda column: np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))
        asking, own, ids = visiting["query_row"].to_numpy(), members["row"].to_numpy(), members["vec_id"].to_numpy()
        owner, found, score = best_of(vectors(visiting["q"]), asking, vectors(members["v"]), own, ids, k)
        return pd.DataFrame({"query_row": asking[owner], "query_id": visiting["query_id"].to_numpy()[owner], "row": own[found], "vec_id": ids[found], "score": score})

    keys = ["leaf", "m", "q_tile"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_row long, query_id long, row long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP) -> DataFrame:
    """The same columns by comparing every query with every vector, for measuring recall: a tree of one leaf."""
    return search(vectors, k, step, sample=1, target=1.0)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, exact.count())

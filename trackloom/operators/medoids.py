"""The member of a group with the least sum of distances to all members, exactly, without all pairs where bounds can tell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trackloom.functions.hashing import md5_code
from trackloom.operators import bounded
from trackloom.session import materialize

BLOCK, SAMPLE, PIVOTS, FIRST = 256, 500, 32, 8
PARTS, BLOCK_NUMBERS = 16, 1 << 21


def _gap(a: str | Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _pivots(nodes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Vectors of each group that lie far apart, from a sample of stated size. They steer the work only; any choice gives the
    same medoid."""
    drawn = bounded.top_per_group(nodes.select(*keys, "id", "vector").withColumn("_h", md5_code(F.col("id"))), keys, [F.col("_h"), F.col("id")], SAMPLE)

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["vector"]).astype(float)
        away = lambda p: np.sqrt(((v - p) ** 2).sum(1))
        chosen = [int(away(v.mean(0)).argmax())]
        gap = away(v[chosen[0]])
        while len(chosen) < n and gap.max() > 1e-9:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, away(v[chosen[-1]]))
        return pdf[keys].head(1).assign(_pivots=[v[chosen].tolist()])

    schema = T.StructType([*[nodes.schema[k] for k in keys], T.StructField("_pivots", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return drawn.select(*keys, "vector").groupBy(*keys).applyInPandas(spread, schema)


def sum_bounds(nodes: DataFrame, keys: list[str], pivots: int = PIVOTS) -> DataFrame:
    """Adds ``bound``, below which a node's sum of distances cannot be.

    Members belong to the cell of the nearest pivot. A distance is a convex function of its end, so the members of a cell are
    on average at least as far from a node as their mean is. ``nodes``: keys, id, vector, weight.
    """
    places = _pivots(nodes, keys, pivots)
    far = F.transform("_pivots", lambda p: _gap("vector", p))
    celled = nodes.join(places, keys).withColumn("_far", far).withColumn("_cell", F.array_position("_far", F.array_min("_far"))).drop("_pivots", "_far")
    celled = materialize(celled, "medoid-nodes")
    each = celled.select(*keys, "_cell", "weight", F.posexplode("vector").alias("_d", "_x"))
    means = each.groupBy(*keys, "_cell", "_d").agg(F.sum("weight").alias("n"), (F.sum(F.col("_x") * F.col("weight")) / F.sum("weight")).alias("_x"))
    # One vector per cell, as many cells per group as pivots.
    cells = means.groupBy(*keys, "_cell").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda e: e["_x"]).alias("mean"))
    cells = cells.groupBy(*keys).agg(F.collect_list(F.struct("n", "mean")).alias("_cells"))
    least = F.aggregate("_cells", F.lit(0.0), lambda s, c: s + _gap("vector", c["mean"]) * c["n"])
    return celled.drop("_cell").join(cells, keys).withColumn("bound", least).drop("_cells")


def _dealt(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """Blocks of rows: keys, number of the block, number of blocks, rows.

    A group has at most PARTS blocks of at least about BLOCK rows, or as many as keep a block below BLOCK_NUMBERS numbers: rows that
    meet every block are then sent a bounded number of times, however large the group is.
    """
    n, width = F.count(F.lit(1)), F.max(F.size("vector"))
    parts = F.greatest(F.least(F.ceil(n / BLOCK), F.lit(PARTS)), F.ceil(n * width / BLOCK_NUMBERS)).cast("int")
    cut = rows.join(rows.groupBy(*keys).agg(parts.alias("_parts")), keys).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    return cut.groupBy(*keys, "_part", "_parts").agg(F.collect_list(F.struct(*fields)).alias(name))


def _vectors(members: pa.StructArray) -> np.ndarray:
    return members.field("vector").flatten().to_numpy().reshape(len(members), -1)


def distance_sums(some: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the distances of ``some`` nodes to all nodes of their group: keys, id, distance_sum."""
    b = _dealt(nodes, keys, ["vector", "weight"], "b")
    # A block of some meets every block of its group under a key of its own.
    a = _dealt(some, keys, ["id", "vector"], "a").drop("_part", "_parts").join(b.groupBy(*keys).agg(F.max("_parts").alias("_parts")), keys)
    a = a.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    schema = T.StructType([*[some.schema[k] for k in [*keys, "id"]], T.StructField("part_sum", T.DoubleType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some, block = batch.column("a")[i].values, batch.column("b")[i].values
                v, n = _vectors(block), block.field("weight").to_numpy().astype(float)
                away = (v - p for p in _vectors(some))
                found = np.array([np.sqrt(np.einsum("ij,ij->i", d, d)) @ n for d in away])
                key = [pa.repeat(batch.column(k)[i], len(some)) for k in keys]
                yield pa.RecordBatch.from_arrays([*key, some.field("id"), pa.array(found)], schema.names)

    met = a.drop("_parts").join(b.drop("_parts"), [*keys, "_part"]).select(*keys, "a", "b")
    return met.mapInArrow(sums, schema).groupBy(*keys, "id").agg(F.sum("part_sum").alias("distance_sum"))


def open_nodes(bounds: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes without a known sum whose bound does not pass the least known sum of their group."""
    least = known.groupBy(*keys).agg(F.min("distance_sum").alias("_least"))
    # A hair above, so that rounding cannot lose the best.
    left = bounds.join(least, keys).where(F.col("bound") <= F.col("_least") * (1.0 + 1e-9) + 1e-6)
    return left.join(known.select(*keys, "id"), [*keys, "id"], "left_anti").drop("_least")


def medoids(points: DataFrame, keys: list[str], pivots: int = PIVOTS) -> DataFrame:
    """The medoid of every group: keys, id, vector, distance_sum, size. Sums that agree to six decimals tie, the smallest id wins.

    ``points``: keys, id (unique in a group), vector (array of double, of one length in a group, without nulls). Equal vectors
    are one node with a weight. The nodes with the least bounds are summed up first; of the others only those that can still
    be better, a block of nodes against a block at a time.
    """
    keys = list(keys)
    nodes = points.groupBy(*keys, "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    bounds = materialize(sum_bounds(materialize(nodes, "medoid-points"), keys, pivots), "medoid-bounds")
    first = bounded.top_per_group(bounds, keys, [F.col("bound"), F.col("id")], FIRST)
    known = materialize(distance_sums(first.select(*keys, "id", "vector"), bounds, keys), "medoid-sums")
    more = distance_sums(open_nodes(bounds, known, keys).select(*keys, "id", "vector"), bounds, keys)
    best = known.unionByName(more).groupBy(*keys).agg(F.min(F.struct(F.round("distance_sum", 6).alias("_s"), "id", "distance_sum")).alias("_m"))
    size = bounds.groupBy(*keys).agg(F.sum("weight").alias("size"))
    found = best.select(*keys, "_m.id", "_m.distance_sum").join(size, keys)
    return found.join(bounds.select(*keys, "id", "vector"), [*keys, "id"])

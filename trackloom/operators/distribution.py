"""Multi-scale RBF maximum mean discrepancy between predicted and true actions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trackloom import constants as K
from trackloom.functions.columns import rbf
from trackloom.operators import bounded, kernel_sums
from trackloom.session import materialize

BLOCK = 1024
FEW = 4 * BLOCK  # different points of a group that are compared pair by pair
PART = 1 << 16  # points of a larger group that one task sums up
POINT = ["ax_pred", "ay_pred", "ax_true", "ay_true"]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _tile_sums(left: pd.Series, right: pd.Series, same: pd.Series) -> pd.Series:
    """Kernel sums (predictions, truths, across) of two blocks of about BLOCK different points with their counts, for both orders."""
    out = []
    for a, b, diagonal in zip(left, right, same):
        p, q = (np.array([[r[c] for c in [*POINT, "_w"]] for r in rows], dtype=float).reshape(-1, len(POINT) + 1) for rows in (a, b))
        m, n = p[:, 4], q[:, 4]

        def kernel(u: np.ndarray, v: np.ndarray, m: np.ndarray = m, n: np.ndarray = n) -> float:
            d2 = (u[:, :1] - v[:, 0]) ** 2 + (u[:, 1:] - v[:, 1]) ** 2
            return float(sum(m @ np.exp(-d2 / (2 * w * w)) @ n for w in K.KERNEL_BANDWIDTHS) / len(K.KERNEL_BANDWIDTHS))

        times = 1 if diagonal else 2
        across = kernel(p[:, :2], q[:, 2:4]) + (0 if diagonal else kernel(q[:, :2], p[:, 2:4], n, m))
        out.append([times * kernel(p[:, :2], q[:, :2]), times * kernel(p[:, 2:4], q[:, 2:4]), across])
    return pd.Series(out)


def _by_tiles(dealt: DataFrame, group: list[str]) -> DataFrame:
    """Kernel sums of pairs of blocks.

    A block is one row of the tile join, and a block meets the others of its group under keys of their own, so that no task
    holds more than two blocks.
    """
    parts = F.ceil(F.col("_points") / BLOCK).cast("int")
    dealt = dealt.withColumns({"_parts": parts, "_b": F.pmod(F.xxhash64("_p"), parts).cast("int")})
    blocks = dealt.groupBy(*group, "n", "_parts", "_b").agg(F.collect_list("_p").alias("_rows"))
    left = blocks.withColumn("_other", F.explode(F.sequence(F.col("_b"), F.col("_parts") - 1)))
    right = blocks.select(*group, F.col("_b").alias("_other"), F.col("_rows").alias("_others"))
    tiles = left.join(right, [*group, "_other"])
    sums = tiles.select(*group, "n", _tile_sums("_rows", "_others", F.col("_b") == F.col("_other")).alias("_s"))
    return sums.select(*group, "n", *[F.col("_s")[i].alias(f"_{v}") for i, v in enumerate(("xx", "yy", "xy"))])


def _by_vectors(dealt: DataFrame, group: list[str]) -> DataFrame:
    """The same sums as scalar products of summed vectors (see ``kernel_sums``): the work grows with the points."""
    points = dealt.select(*group, "n", "_p.*", F.pmod(F.xxhash64("_p"), F.ceil(F.col("_points") / PART)).alias("_part"))
    levels = kernel_sums.Levels.over(points, ["ax_pred", "ax_true"], ["ay_pred", "ay_true"])
    kept = points.select(*group, "n").schema
    found = T.StructType([*kept.fields, *[T.StructField(c, T.LongType()) for c in ("_level", "_i", "_j")],
                          T.StructField("_truth", T.BooleanType()), T.StructField("_v", T.ArrayType(T.DoubleType()))])

    def spread(rows: pa.Table) -> pa.Table:
        value = {c: rows.column(c).to_numpy().astype(float) for c in [*POINT, "_w"]}
        out = [(level, i, j, kind == "true", vector) for kind in ("pred", "true")
               for level, i, j, vector in levels.sums(value[f"ax_{kind}"], value[f"ay_{kind}"], value["_w"])]
        own = rows.select(kept.names).take(pa.array([0] * len(out), pa.int64()))
        numbers = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
        vectors = pa.array([r[4] for r in out], pa.list_(pa.float64()))
        return pa.Table.from_arrays([*own.columns, *numbers, pa.array([r[3] for r in out], pa.bool_()), vectors], found.names)

    vectors = points.groupBy(*group, "_part").applyInArrow(spread, found)
    side = lambda truth: F.coalesce(F.sum(F.when(F.col("_truth") == truth, F.col("_c"))), F.lit(0.0))
    at = [*group, "n", "_level", "_i", "_j", "_k"]
    one = vectors.select(*at[:-1], "_truth", F.posexplode("_v").alias("_k", "_c")).groupBy(*at).agg(side(False).alias("_x"), side(True).alias("_y"))
    met = one.select(*at, "_x", "_y", F.explode(levels.met(F.col("_level"))).alias("_step"))
    met = met.select(*group, "n", "_level", (F.col("_i") + F.col("_step.i")).alias("_i"), (F.col("_j") + F.col("_step.j")).alias("_j"), "_k", "_x", "_y")
    other = one.withColumnsRenamed({"_x": "_u", "_y": "_v"})
    times = lambda a, b: (F.sum(F.col(a) * F.col(b)) / len(K.KERNEL_BANDWIDTHS))
    return met.join(other, at).groupBy(*group, "n").agg(
        times("_x", "_u").alias("_xx"), times("_y", "_v").alias("_yy"), times("_x", "_v").alias("_xy"))


def _pairwise(df: DataFrame, group: list[str]) -> DataFrame:
    """Kernel sums per group over all pairs of rows.

    Equal rows are one point with a count, so that no value can fill a block. Pairs of small groups are compared in tiles of
    two blocks; of larger ones vectors are summed, which gives the same sums without their pairs.
    """
    points = df.groupBy(*group, *POINT).agg(F.count(F.lit(1)).alias("_w"))
    rows = points.select(*group, F.struct(*POINT, "_w").alias("_p"))
    sizes = rows.groupBy(*group).agg(F.sum("_p._w").cast("long").alias("n"), F.count(F.lit(1)).alias("_points"))
    dealt = materialize(rows.join(sizes, group) if group else rows.crossJoin(sizes), "points")  # one row
    sums = _by_tiles(dealt.where(F.col("_points") <= FEW), group)
    large = dealt.where(F.col("_points") > FEW)
    if not large.isEmpty():
        sums = sums.unionByName(_by_vectors(large, group))
    return sums.groupBy(*group).agg(F.max("n").alias("n"), *[F.sum(f"_{v}").alias(f"_{v}") for v in ("xx", "yy", "xy")])


def _v_statistic() -> Column:
    return (F.col("_xx") + F.col("_yy") - F.col("_xy") * 2) / (F.col("n") * F.col("n"))


def mmd2_exact(df: DataFrame, group: list[str]) -> DataFrame:
    """U-statistic for the two within terms, full mean across; V-statistic if clearly negative; floor at 0."""
    s = _pairwise(df, group)
    n = F.col("n")
    u = (F.col("_xx") - n) / (n * (n - 1)) + (F.col("_yy") - n) / (n * (n - 1)) - F.col("_xy") * 2 / (n * n)
    value = F.when(n < 2, 0.0).otherwise(F.when(u < -1e-12, _v_statistic()).otherwise(u))
    return s.select(*group, n.alias("n"), F.greatest(value, F.lit(0.0)).alias("mmd2"), F.lit("exact").alias("method"))


def mmd2_v(df: DataFrame, group: list[str]) -> DataFrame:
    """V-statistic over all rows."""
    return _pairwise(df, group).select(
        *group, "n", F.greatest(_v_statistic(), F.lit(0.0)).alias("mmd2"), F.lit("v").alias("method"))


def mmd2_linear(df: DataFrame, group: list[str], levels: list[str], order: list[str], chunk: Column,
                fallback: bool = True) -> DataFrame:
    """Linear-time estimate over adjacent rows (2i, 2i+1) of the declared order (levels..., order...).

    ``fallback`` replaces an estimate that is clearly negative by the V-statistic over all rows of its group.
    """
    placed = bounded.nested_positions(df, levels, order, chunk, "_pos", within=group)
    pair = F.floor(F.col("_pos") / 2)
    side = lambda c, k: F.max(F.when(F.col("_pos") % 2 == k, F.col(c))).alias(f"{c}{k}")
    pairs = placed.groupBy(*group, pair.alias("_i")).agg(
        F.count(F.lit(1)).alias("_c"), *[side(c, k) for c in POINT for k in (0, 1)]
    ).where(F.col("_c") == 2)

    def k(x: str, y: str) -> Column:
        return rbf(F.pow(F.col(f"ax_{x}") - F.col(f"ax_{y}"), 2) + F.pow(F.col(f"ay_{x}") - F.col(f"ay_{y}"), 2))

    term = k("pred0", "pred1") + k("true0", "true1") - k("pred0", "true1") - k("pred1", "true0")
    est = pairs.groupBy(*group).agg((F.avg(term) * 2).alias("_est"), (F.count(F.lit(1)) * 2).alias("n"))
    if fallback:
        bad = est.where(F.col("_est") < -1e-12)
        pool = df.join(bad.select(*group), group, "left_semi") if group else df.crossJoin(bad.select(F.lit(1).alias("_x"))).drop("_x")
        again = _pairwise(pool, group).select(*group, _v_statistic().alias("_again"))
        est = est.join(again, group, "left") if group else est.join(again, F.lit(True), "left")
        est = est.withColumn("_est", F.coalesce(F.when(F.col("_est") < -1e-12, F.col("_again")), F.col("_est")))
    return est.select(*group, "n", F.greatest(F.col("_est"), F.lit(0.0)).alias("mmd2"), F.lit("linear").alias("method"))


def mmd2(df: DataFrame, group: list[str], levels: list[str], order: list[str], chunk: Column, method: str = "exact") -> DataFrame:
    """mmd2 and mmd by the method that the caller names: ``exact``, ``v`` or ``linear``."""
    if method == "linear":
        out = mmd2_linear(df, group, levels, order, chunk)
    elif method in ("exact", "v"):
        out = mmd2_exact(df, group) if method == "exact" else mmd2_v(df, group)
    else:
        raise ValueError(f"unknown method {method!r}; choices: exact, v, linear")
    return out.withColumn("mmd", F.sqrt("mmd2"))

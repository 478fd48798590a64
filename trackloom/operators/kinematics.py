"""Smoothing and derivatives for corpora that only record positions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from trackloom.functions import smoothing as S
from trackloom.operators import bounded
from trackloom.session import materialize

POSITION_WINDOW, DERIVATIVE_WINDOW, POLY = 51, 31, 3
CHUNK = 1024


def time_step(rows: DataFrame, keys: list[str], frame: str, rate: float, stamp: str | None = None, default: float | None = None) -> DataFrame:
    """Median positive difference of ``stamp`` (the frame, if none is given) in frame order, over ``rate``, per track;
    ``default`` (1 / rate, if none is given) where there is none."""
    stamp = stamp or frame
    steps = bounded.previous_row(rows, keys, [frame], {"_pf": stamp}).withColumn("_step", F.col(stamp) - F.col("_pf"))
    median = bounded.quantile_columns(steps.where(F.col("_step") > 0), keys, F.col("_step"), {"_m": 0.5})
    out = rows.select(*keys).distinct().join(median, keys, "left")
    return out.select(*keys, F.coalesce(F.col("_m") / rate, F.lit(1.0 / rate if default is None else default)).alias("dt"))


def _with_surroundings(rows: DataFrame, keys: list[str], order: str, halo: int) -> DataFrame:
    """Row positions, track sizes and copies of edge rows, so every chunk can be smoothed on its own."""
    return bounded.with_halo(_placed(rows, keys, order), "_pos", halo, halo, CHUNK)


def _placed(rows: DataFrame, keys: list[str], order: str, stamp: str | None = None) -> DataFrame:
    """Row positions and track sizes, with ``stamp`` also its step from the row before (``_step``), from one sort of the rows.

    One summary of the chunks of a track carries the rows before a chunk, those of the track and the stamp that a chunk begins behind.
    """
    parts = rows.withColumn("_part", bounded.frame_chunk(order))
    edge = {"_edge": F.max_by(stamp, order)} if stamp else {}
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in edge.items()])
    chunks = W.partitionBy(*keys)
    along = chunks.orderBy("_part")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_part", before.alias("_before"), F.sum("_n").over(chunks).alias("_total"), *[F.lag(n).over(along).alias(n) for n in edge])
    inner = W.partitionBy(*keys, "_part").orderBy(order)
    out = parts.join(sizes, [*keys, "_part"]).withColumn("_pos", (F.row_number().over(inner) - 1 + F.col("_before")).cast("long"))
    if stamp:
        first = F.row_number().over(inner) == 1
        out = out.withColumn("_step", F.col(stamp) - F.when(first, F.col("_edge")).otherwise(F.lag(stamp).over(inner)))
    return out.drop("_part", "_before", *edge)


def _with_time_step(rows: DataFrame, keys: list[str], rate: float, halo: int, stamp: str = "frame", default: float | None = None) -> DataFrame:
    """:func:`_with_surroundings` and :func:`time_step` (``dt``) of rows that are written once between the two."""
    placed = materialize(_placed(rows, keys, "frame", stamp), "placed")
    steps = placed.where(F.col("_step") > 0).groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_n"))
    median = bounded.quantiles(steps, keys, F.col("_step"), [0.5], "_m", F.col("_n"))
    dt = median.select(*keys, (F.col("_m")[0] / rate).alias("dt"))
    cut = bounded.with_halo(placed.drop("_step"), "_pos", halo, halo, CHUNK).join(dt, keys, "left")
    return cut.withColumn("dt", F.coalesce("dt", F.lit(1.0 / rate if default is None else default)))


def _by_chunk(cut: DataFrame, keys: list[str], read: list[str], made: list[str], run: Callable[[dict[str, np.ndarray], int, int, float], dict[str, np.ndarray]]) -> DataFrame:
    """Own rows of every chunk with the columns ``made``, which ``run`` computes of the columns ``read`` of the sorted
    chunk, its first position, the size of its track and dt; what is no number becomes null. Other columns pass as they are."""
    names = [c for c in cut.columns if c not in {*made, "_pos", "_total", "_chunk", "_own", "dt"}]
    schema = T.StructType([*[cut.schema[c] for c in names], *[T.StructField(c, T.DoubleType()) for c in made]])

    def each(chunk: pa.Table) -> pa.Table:
        pos = chunk.column("_pos").to_numpy()
        order = np.argsort(pos, kind="stable")
        values = {c: chunk.column(c).to_numpy()[order].astype(float) for c in read}
        found = run(values, int(pos[order[0]]), int(chunk.column("_total")[0].as_py()), float(chunk.column("dt")[0].as_py()))
        own = chunk.column("_own").to_numpy(zero_copy_only=False)[order]
        kept = chunk.select(names).take(pa.array(order[own]))
        return pa.Table.from_arrays([*kept.columns, *[pa.array(found[c][own], pa.float64(), from_pandas=True) for c in made]], schema.names)

    return cut.groupBy(*keys, "_chunk").applyInArrow(each, schema)


def smoothed(rows: DataFrame, keys: list[str], order: str, value: str, window: int, poly: int = POLY, deriv: int = 0) -> DataFrame:
    """Local polynomial smoothing (or derivative per row) of one column; short tracks shrink the window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        total = int(pdf["_total"].iloc[0])
        win = S.odd_window(total, window, poly)
        v = pdf[value].to_numpy(float)
        out = S.smooth(v, int(pdf["_pos"].iloc[0]), total, win, poly, deriv) if win else (v if deriv == 0 else np.full(len(v), np.nan))
        return pdf[[*keys, order]].assign(smoothed=out)[pdf["_own"].to_numpy()]

    cut = _with_surroundings(rows.select(*keys, order, value), keys, order, window)
    schema = ", ".join([*[f"{k} string" for k in keys], f"{order} bigint", "smoothed double"])
    return cut.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def add_kinematics(rows: DataFrame, keys: list[str], rate: float, position_window: int = POSITION_WINDOW,
                   derivative_window: int = DERIVATIVE_WINDOW, course: str | None = None) -> DataFrame:
    """Smoothed x, y, velocities, accelerations and heading from positions in metres.

    Positions are smoothed first, derivatives come from the smoothed positions. A chunk sees enough rows
    around it for both passes, so tracks of any length are handled in bounded pieces. ``course`` (degrees)
    replaces the heading where the track hardly moves.
    """
    halo = position_window + derivative_window
    cut = _with_time_step(rows, keys, rate, halo)

    def run(values: dict[str, np.ndarray], first: int, total: int, delta: float) -> dict[str, np.ndarray]:
        out = {}
        win = S.odd_window(total, position_window, POLY)
        dwin = S.odd_window(total, derivative_window, POLY)
        t = values["frame"] / rate
        for axis in "xy":
            p = values[axis]
            p = S.smooth(p, first, total, win, POLY) if win else p
            if dwin:
                # The outermost halo rows are not smoothed; they are cut off before the second pass.
                ok = np.flatnonzero(~np.isnan(p))
                lo, hi = ok[0], ok[-1] + 1
                v, a = np.full(len(p), np.nan), np.full(len(p), np.nan)
                v[lo:hi] = S.smooth(p[lo:hi], first + lo, total, dwin, POLY, 1, delta)
                a[lo:hi] = S.smooth(p[lo:hi], first + lo, total, dwin, POLY, 2, delta)
            elif total >= 3:
                v = S.gradient(p, t)
                a = S.gradient(v, t)
            else:
                v = S.gradient(p, np.arange(total) * delta)
                a = np.zeros_like(v)
            out[axis], out[f"v{axis}"], out[f"a{axis}"] = p, v, a
        heading = np.arctan2(out["vy"], out["vx"])
        if course:
            heading = np.where(np.hypot(out["vx"], out["vy"]) < 1e-3, np.deg2rad(values[course]), heading)
        return out | {"heading": heading}

    return _by_chunk(cut.where(F.col("_total") >= 2), keys, ["frame", "x", "y", *([course] if course else [])], ["x", "vx", "ax", "y", "vy", "ay", "heading"], run)


def velocity_derivative(rows: DataFrame, keys: list[str], window: int = 9, poly: int = 2) -> DataFrame:
    """ax, ay from vx, vy by a local quadratic; short tracks use plain gradients over the time stamps.

    ``timestamp_ms`` gives the time; tracks with fewer than three rows get no acceleration.
    """
    cut = _with_time_step(rows, keys, 1000.0, window, "timestamp_ms", 0.1)

    def run(values: dict[str, np.ndarray], first: int, total: int, delta: float) -> dict[str, np.ndarray]:
        win = S.odd_window(total, window, poly, strict=True)
        t = values["timestamp_ms"] / 1000.0
        out = {}
        for axis in "xy":
            v = values[f"v{axis}"]
            if total < 3:
                a = np.full(len(v), np.nan)
            elif win:
                a = S.smooth(v, first, total, win, poly, 1, delta)
            else:
                a = S.gradient(v, t) if (np.diff(t) > 0).all() else np.gradient(v, delta)
            out[f"a{axis}"] = a
        return out

    return _by_chunk(cut, keys, ["timestamp_ms", "vx", "vy"], ["ax", "ay"], run)

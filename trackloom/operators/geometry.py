"""Polyline operators. Long polylines are rows; short ones (at most a few hundred points) are arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from trackloom.functions import lines
from trackloom.functions.columns import finite
from trackloom.operators import bounded
from trackloom.session import spread

PROJECTED = ["lateral", "segment", "s", "tx", "ty"]
BLOCK_CELLS = 1 << 19  # points times vertices that are compared at once


def clean_polyline(points: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Drop non-finite points, then points that do not move from the one before."""
    rows = points.where(finite("x") & finite("y"))
    rows = bounded.previous_row(rows, keys, [order], {"_px": "x", "_py": "y"})
    moved = F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py")) > 1e-9
    return rows.where(F.col("_px").isNull() | moved).drop("_px", "_py")


def _steps(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    rows = bounded.previous_row(points, keys, [order], {"px": "x", "py": "y"})
    return rows.withColumn(
        "step_len", F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0)))


def arc_length(points: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Adds the previous point (px, py), the step length and the arc length ``s``."""
    return bounded.running_sums(_steps(points, keys, order), keys, [order], {"s": F.col("step_len")})


def sample_grid(points: DataFrame, keys: list[str], n: int, lo: Column, hi: Column) -> DataFrame:
    """n equally spaced points between arc lengths ``lo`` and ``hi`` by linear interpolation.

    Every segment emits the grid points it brackets, so sampling needs no join and at most n rows per key
    are shuffled. ``points`` come from :func:`arc_length`; ``lo`` and ``hi`` are constant per key.
    """
    rows = points.withColumns({"_lo": lo, "_hi": hi, "_s0": F.col("s") - F.col("step_len")})
    step = (F.col("_hi") - F.col("_lo")) / (n - 1)
    at = lambda s: F.floor((s - F.col("_lo")) / F.col("_h"))
    rows = rows.withColumn("_h", step).where((F.col("step_len") > 1e-9) & (F.col("_h") > 0))
    k0 = F.greatest(F.lit(0), at(F.col("_s0")))
    k1 = F.least(F.lit(n - 1), at(F.col("s")) + 1)
    rows = rows.where(k0 <= k1).withColumn("seq", F.explode(F.sequence(k0.cast("int"), k1.cast("int"))))
    t = F.col("_lo") + F.col("seq") * F.col("_h")
    outside = F.greatest(F.col("_s0") - t, t - F.col("s"), F.lit(0.0))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - F.col("_s0")) / F.col("step_len")))
    rows = rows.withColumn("_out", outside).withColumn(
        "_p", F.struct((F.col("px") + (F.col("x") - F.col("px")) * u).alias("x"), (F.col("py") + (F.col("y") - F.col("py")) * u).alias("y"))
    )
    best = rows.groupBy(*keys, "seq").agg(F.min(F.struct("_out", "_p")).alias("_b"))
    return best.select(*keys, F.col("seq").cast("long").alias("seq"), F.col("_b._p.x").alias("x"), F.col("_b._p.y").alias("y"))


def resample(points: DataFrame, keys: list[str], n: int, order: str = "seq") -> DataFrame:
    """n points equally spaced by arc length; a polyline without length repeats its first point.

    For tracks of any length. Short lines held as arrays use :func:`with_resampled`.
    """
    steps = _steps(points.select(*keys, order, "x", "y"), keys, order)
    total = steps.groupBy(*keys).agg(F.sum("step_len").alias("_total"), F.min_by(F.struct("x", "y"), order).alias("_first"))
    s = bounded.running_sums(steps, keys, [order], {"s": F.col("step_len")})
    placed = s.join(total.where(F.col("_total") > 1e-9).select(*keys, "_total"), keys)
    moving = sample_grid(placed, keys, n, F.lit(0.0), F.col("_total"))
    still = total.where(F.col("_total") <= 1e-9).select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("seq"), "_first.x", "_first.y"
    )
    return moving.unionByName(still)


def with_resampled(df: DataFrame, n: int, source: str = "line", name: str = "line") -> DataFrame:
    """Adds the short line ``source`` resampled to n points as ``name`` (one Arrow call per batch)."""
    return df.withColumn(name, lines.resample_lines(source, F.lit(n)))


def to_array(points: DataFrame, keys: list[str], name: str = "line", order: str = "seq") -> DataFrame:
    """Ordered array of (x, y). Only for resampled, hence short, polylines."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "x", "y")))
    return points.groupBy(*keys).agg(
        F.transform(rows, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias(name)
    )


def gap(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def line_length(line: Column) -> Column:
    ahead = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    steps = F.zip_with(line, ahead, lambda a, b: F.coalesce(gap(a, b), F.lit(0.0)))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def _ends(line: Column, from_start: bool) -> tuple[Column, Column]:
    n = F.size(line)
    if from_start:
        return F.element_at(line, F.least(F.lit(6), n)), F.element_at(line, 1)
    return F.element_at(line, n), F.element_at(line, F.greatest(F.lit(1), n - 5))


def direction_dot(a: Column, b: Column, from_start: bool) -> Column:
    """Cosine between the first (or last) five steps of two lines."""
    return _cosine(*_ends(a, from_start), *_ends(b, from_start))


def _cosine(a1: Column, a0: Column, b1: Column, b0: Column) -> Column:
    ax, ay, bx, by = a1["x"] - a0["x"], a1["y"] - a0["y"], b1["x"] - b0["x"], b1["y"] - b0["y"]
    return (ax * bx + ay * by) / F.greatest(F.hypot(ax, ay) * F.hypot(bx, by), F.lit(1e-9))


def turn_dot(line: Column) -> Column:
    """Cosine between the start and the end direction of one line."""
    return _cosine(*_ends(line, True), *_ends(line, False))


def mean_gap(a: Column, b: Column) -> Column:
    """Mean point distance of two equally sampled lines; direction matters."""
    return F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def nearest_gaps(a: Column, b: Column) -> Column:
    """For each point of ``a`` the distance to the nearest vertex of ``b``."""
    return F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: gap(p, q))))


def array_quantile(values: Column, p: float, presorted: bool = False) -> Column:
    """Linear-interpolation quantile of a short array."""
    v = values if presorted else F.array_sort(values)
    at = (F.size(v) - 1) * F.lit(p)
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.element_at(v, lo + 1), F.element_at(v, hi + 1)
    return a + (b - a) * (at - F.floor(at))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def discrete_frechet(a: Column, b: Column) -> Column:
    """Discrete Frechet distance of two short lines by a row-wise dynamic programme."""
    columns = F.sequence(F.lit(0), F.size(b) - 1)
    empty = F.array().cast("array<double>")

    def next_row(prev: Column, d: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            best = F.when(j == 0, prev[0]).otherwise(F.least(prev[j], prev[F.greatest(j - 1, F.lit(0))], F.element_at(row, -1)))
            return F.array_append(row, F.greatest(best, d[j]))

        # The start value has one element so that element_at is defined; it is sliced off again.
        return F.slice(F.aggregate(columns, F.array(F.lit(float("inf"))), cell), 2, F.size(b))

    def over(grid: Column) -> Column:
        first = F.aggregate(columns, empty, lambda row, j: F.array_append(row, F.when(j == 0, grid[0][0]).otherwise(F.greatest(F.element_at(row, -1), grid[0][j]))))
        return F.element_at(F.aggregate(F.slice(grid, 2, F.size(a)), first, next_row), -1)

    return bind(F.transform(a, lambda p: F.transform(b, lambda q: gap(p, q))), over)


def self_intersects(line: Column) -> Column:
    """True if two non-adjacent segments of a short line cross."""
    index = F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0)))
    segs = F.transform(index, lambda i: F.struct(i.alias("i"), line[i].alias("a"), F.get(line, i + 1).alias("b")))

    def side(p: Column, q: Column, r: Column) -> Column:
        o = (r["y"] - p["y"]) * (q["x"] - p["x"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
        # Straight stretches are sampled on one line; rounding there must not count as a crossing.
        return F.when(F.abs(o) > 1e-9, F.signum(o)).otherwise(0.0)

    def cross(s: Column, t: Column) -> Column:
        a, b, c, d = s["a"], s["b"], t["a"], t["b"]
        return (side(a, c, d) * side(b, c, d) < 0) & (side(a, b, c) * side(a, b, d) < 0)

    hit = F.exists(segs, lambda s: F.exists(segs, lambda t: (t["i"] >= s["i"] + 2) & cross(s, t)))
    return F.when(F.size(line) < 4, False).otherwise(F.coalesce(hit, F.lit(False)))


def numeric_gradient(rows: DataFrame, keys: list[str], order: str, value: str, at: str | None = None, name: str = "gradient") -> DataFrame:
    """Second-order central differences, one-sided at the ends; spacing 1 or given by column ``at``."""
    src = {"_v": value} | ({"_t": at} if at else {})
    out = bounded.previous_row(rows, keys, [order], {f"_p{k}": c for k, c in src.items()})
    out = bounded.previous_row(out, keys, [order], {f"_n{k}": c for k, c in src.items()}, forward=True)
    v, pv, nv = F.col(value), F.col("_p_v"), F.col("_n_v")
    left = F.col(at) - F.col("_p_t") if at else F.lit(1.0)
    right = F.col("_n_t") - F.col(at) if at else F.lit(1.0)
    inner = (left * left * nv + (right * right - left * left) * v - right * right * pv) / (left * right * (left + right))
    g = F.when(pv.isNotNull() & nv.isNotNull(), inner).when(nv.isNotNull(), (nv - v) / right).when(
        pv.isNotNull(), (v - pv) / left).otherwise(0.0)
    return out.withColumn(name, g).drop(*[f"_{s}{k}" for s in "pn" for k in src])


def _unit_gradient(value: str, w) -> Column:
    lag, lead, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(lag.isNotNull() & lead.isNotNull(), (lead - lag) / 2).when(lead.isNotNull(), lead - v).when(
        lag.isNotNull(), v - lag).otherwise(0.0)


def path_geometry(points: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Arc length, unit tangent and curvature of sampled paths (a fixed, small number of points each)."""
    w = W.partitionBy(*keys).orderBy(order)
    lag = lambda c: F.lag(c).over(w)
    df = points.withColumn("_d", F.coalesce(F.hypot(F.col("x") - lag("x"), F.col("y") - lag("y")), F.lit(0.0)))
    df = df.withColumn("s", F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumns({"_gx": _unit_gradient("x", w), "_gy": _unit_gradient("y", w), "_gs": _unit_gradient("s", w),
                         "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    norm = F.greatest(F.hypot("_gx", "_gy"), F.lit(1e-9))
    ds = F.greatest(F.col("_gs"), F.lit(1e-6))
    df = df.withColumns({"tx": F.col("_gx") / norm, "ty": F.col("_gy") / norm, "_dx": F.col("_gx") / ds, "_dy": F.col("_gy") / ds, "_ds": ds})
    df = df.withColumns({"_ddx": _unit_gradient("_dx", w) / F.col("_ds"), "_ddy": _unit_gradient("_dy", w) / F.col("_ds")})
    dx, dy = F.col("_dx"), F.col("_dy")
    kappa = (dx * F.col("_ddy") - dy * F.col("_ddx")) / F.greatest(F.pow(dx * dx + dy * dy, 1.5), F.lit(1e-9))
    return df.withColumn("kappa", F.when(F.col("_n") < 3, 0.0).otherwise(kappa)).drop(
        "_d", "_gx", "_gy", "_gs", "_n", "_dx", "_dy", "_ds", "_ddx", "_ddy")


def projection(points: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest segment of a short path for every point: arc length there, lateral distance, tangent.

    ``points``: keys, point, x, y. ``vertices``: one row per key with an array ``line``. Points are dealt to all tasks, since
    they have few bytes and much work, and are compared with their lines on Arrow batches, many at once.
    """
    kept, new = points.columns, [T.StructField(c, T.IntegerType() if c == "segment" else T.DoubleType()) for c in PROJECTED]
    df = spread(points).join(vertices.select(*keys, "line"), keys)
    schema = T.StructType([*[points.schema[c] for c in kept], *new])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _projected(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"], axis=1), *lines.points_of(batch.column("line")))
            made = [pa.array(found[c], pa.int32() if c == "segment" else pa.float64(), from_pandas=False) for c in PROJECTED]
            # A missing coordinate makes missing values, not numbers that are none.
            missing = pc.or_(pc.is_null(batch.column("x")), pc.is_null(batch.column("y")))
            made = [a if c == "segment" else pc.if_else(pc.and_(missing, pc.is_nan(a)), pa.scalar(None, pa.float64()), a) for c, a in zip(PROJECTED, made)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], schema.names)

    return df.select(*kept, "line").mapInArrow(each, schema)


def _projected(p: np.ndarray, sizes: np.ndarray, first: np.ndarray, xy: np.ndarray) -> dict[str, np.ndarray]:
    """Every row's point on its line; the first of equally near segments. Lines of one size are looked at together."""
    out = {c: np.zeros(len(p), np.int32) if c == "segment" else np.full(len(p), np.nan) for c in PROJECTED}
    for size in np.unique(sizes[sizes > 1]).tolist():
        rows = np.flatnonzero(sizes == size)
        for part in np.array_split(rows, len(rows) * size // BLOCK_CELLS + 1):
            line = xy[first[part][:, None] + np.arange(size)]
            x, y = line[:, :-1, 0], line[:, :-1, 1]
            vx, vy = np.diff(line[..., 0], axis=1), np.diff(line[..., 1], axis=1)
            square, length = np.maximum(vx * vx + vy * vy, 1e-12), np.hypot(vx, vy)
            px, py = p[part, 0:1], p[part, 1:2]
            u = np.fmax(0.0, np.fmin(1.0, ((px - x) * vx + (py - y) * vy) / square))
            ex, ey = px - x - u * vx, py - y - u * vy
            gap = ex * ex + ey * ey
            at = np.where(np.isnan(gap), np.inf, gap).argmin(1)[:, None]
            of = lambda values: np.take_along_axis(values, at, 1)[:, 0]
            arc = np.cumsum(np.c_[np.zeros(len(part)), length], axis=1)
            unit = np.maximum(of(length), 1e-12)
            for c, v in zip(PROJECTED, (np.sqrt(of(gap)), at[:, 0], of(arc) + of(u) * of(length), of(vx) / unit, of(vy) / unit)):
                out[c][part] = v
    return out


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A column that a lambda reads is otherwise put in its place by the
    optimizer and computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_segments(line: Column) -> Column:
    """Segments of a short line: start, step, squared and plain length, arc length at the start."""
    def segment(i: Column, arc: Column) -> Column:
        a, b = line[i], line[i + 1]
        vx, vy = b["x"] - a["x"], b["y"] - a["y"]
        return F.struct(a["x"].alias("x"), a["y"].alias("y"), vx.alias("vx"), vy.alias("vy"), F.greatest(vx * vx + vy * vy, F.lit(1e-12)).alias("square"),
                        F.hypot(vx, vy).alias("length"), arc[i].alias("s"))

    return bind(line_arcs(line), lambda arc: F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda i: segment(i, arc)))


def project_point(p: Column, segments: Column) -> Column:
    """The nearest of a line's segments (the first of equally near ones): lateral, segment, s, tx, ty."""
    def along(g: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - g["x"]) * g["vx"] + (p["y"] - g["y"]) * g["vy"]) / g["square"]))

    def square_gap(g: Column, u: Column) -> Column:
        ex, ey = p["x"] - g["x"] - u * g["vx"], p["y"] - g["y"] - u * g["vy"]
        return ex * ex + ey * ey

    steps = F.transform(segments, along)
    near = F.array_min(F.transform(F.zip_with(segments, steps, lambda g, u: square_gap(g, u)), lambda d, i: F.struct(d.alias("d"), i.alias("i"))))

    def found(best: Column) -> Column:
        g = F.get(segments, best["i"])
        return bind(F.struct(g.alias("g"), along(g).alias("u")), lambda v: F.struct(
            F.sqrt(best["d"]).alias("lateral"), best["i"].alias("segment"), (v["g"]["s"] + v["u"] * v["g"]["length"]).alias("s"),
            (v["g"]["vx"] / F.greatest(v["g"]["length"], F.lit(1e-12))).alias("tx"), (v["g"]["vy"] / F.greatest(v["g"]["length"], F.lit(1e-12))).alias("ty")))

    return bind(near, found)


def at_arcs(line: Column, arc: Column, where: Column) -> Column:
    """Points of a short line at the given arc lengths, by linear interpolation; beyond the ends the end points."""
    last = F.size(line) - 1
    found = F.transform(where, lambda t: F.struct(t.alias("t"), F.greatest(F.lit(1), F.least(last, F.size(F.filter(arc, lambda a: a <= t)))).alias("j")))

    def between(f: Column) -> Column:
        a, b, s0, s1 = F.get(line, f["j"] - 1), F.get(line, f["j"]), F.get(arc, f["j"] - 1), F.get(arc, f["j"])
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (f["t"] - s0) / F.greatest(s1 - s0, F.lit(1e-12))))
        return F.struct((a["x"] + (b["x"] - a["x"]) * u).alias("x"), (a["y"] + (b["y"] - a["y"]) * u).alias("y"))

    return F.transform(found, between)


def line_arcs(line: Column) -> Column:
    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), gap)
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))


def nearest_vertex(points: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest vertex of a short path: arc length there, distance, index."""
    df = points.join(vertices, keys)
    index = F.sequence(F.lit(0), F.size("line") - 1)
    best = bind(line_arcs(F.col("line")), lambda arc: F.array_min(F.transform(index, lambda i: F.struct(
        F.hypot(F.col("x") - F.col("line")[i]["x"], F.col("y") - F.col("line")[i]["y"]).alias("distance"),
        i.alias("vertex"), arc[i].alias("s")))))
    return df.withColumn("_b", best).select(*points.columns, "_b.*")


def between_paths(paths: DataFrame, scene: list[str] = ("dataset", "scene_id")) -> DataFrame:
    """For every ordered pair of paths of a scene and every point of the first: arc length at the nearest
    vertex of the second, signed distance, heading difference and topology code.

    ``paths``: scene, path_id, seq, x, y, s, tx, ty with the same small number of points per path. A scene has
    few paths; the join is an equi-join on the scene.
    """
    scene = list(scene)
    second = paths.groupBy(*scene, F.col("path_id").alias("other_path_id")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "x", "y", "s", "tx", "ty"))).alias("_v"))
    near = F.array_min(F.transform("_v", lambda q: F.struct(
        F.hypot(q["x"] - F.col("x"), q["y"] - F.col("y")).alias("d"), q["seq"].alias("j"), q.alias("q"))))
    df = paths.join(second, scene).withColumn("_n", near)
    q = F.col("_n.q")
    cross = F.col("tx") * (q["y"] - F.col("y")) - F.col("ty") * (q["x"] - F.col("x"))
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("tx") * q["tx"] + F.col("ty") * q["ty"]))
    return df.select(
        *scene, "path_id", "other_path_id", "seq", q["s"].alias("other_s"),
        (F.col("_n.d") * F.when(cross >= 0, 1.0).otherwise(-1.0)).alias("signed_distance"),
        F.acos(dot).alias("heading_difference"),
        F.when(F.col("path_id") == F.col("other_path_id"), 0.0).otherwise(4.0).alias("topology"),
    )

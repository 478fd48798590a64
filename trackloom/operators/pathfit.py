"""How well a sampled track follows a directed path.

``pairs`` hold ``track`` and ``line``, arrays of (x, y). Both fits work on Arrow batches of pairs, many pairs at once, and
are dealt to all tasks: a pair has few bytes and much work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from trackloom.functions.lines import points_of
from trackloom.session import spread

FRECHET_STEP = 4
FIT = ["segment_mean", "lateral_mean", "lateral_p90", "frechet", "direction", "start_dot", "end_dot", "monotonic"]
LANE = ["first_mean", "first_p90", "first_direction", "first_monotonic", "direction", "monotonic"]
POINT = ("lateral", "dot", "advance")
BLOCK_CELLS = 1 << 19  # points times vertices that are compared at once


def scored(pairs: DataFrame) -> DataFrame:
    """Puts segment_mean, lateral_mean, lateral_p90, frechet, direction, start_dot, end_dot and monotonic in the place of
    ``track`` and ``line``.

    The track is compared with the stretch of the path between the 2nd and 98th percentile of its projections (between
    the extremes, if those coincide); without any extent there is no segment_mean and no frechet. A track without points
    or a path of fewer than two has no value at all. Pairs are fitted together, in blocks of bounded size.
    """
    kept, names = _kept(pairs)
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in FIT]])

    def fitted(batches):
        for batch in batches:
            values = _fit_batch(batch.column("track"), batch.column("line"))
            columns = [batch.column(n) for n in names] + [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in values.T]
            yield pa.RecordBatch.from_arrays(columns, names + FIT)

    return spread(pairs, *names).mapInArrow(fitted, schema)


def _kept(pairs: DataFrame) -> tuple[list[T.StructField], list[str]]:
    kept = [f for f in pairs.schema.fields if f.name not in ("track", "line")]
    return kept, [f.name for f in kept]


def _blocks(nt: np.ndarray, nl: np.ndarray):
    """Rows that are fitted together, and the size of their tracks; tracks without points and paths of fewer than two are
    left out."""
    for n in np.unique(nt[(nt > 0) & (nl > 1)]):
        rows = np.flatnonzero((nt == n) & (nl > 1))
        rows = rows[np.argsort(nl[rows], kind="stable")]
        while len(rows):
            # Lines are in order of size, so the last of a block is its longest.
            fits = np.arange(1, len(rows) + 1) * nl[rows] * n <= BLOCK_CELLS
            now, rows = np.split(rows, [max(1, int(fits.sum()))])
            yield now, int(n)


def _fit_batch(tracks: pa.ListArray, lines: pa.ListArray) -> np.ndarray:
    """One row of ``FIT`` for each pair; pairs with tracks of one size share a block, their lines padded to the longest."""
    (nt, at, t), (nl, al, l) = points_of(tracks), points_of(lines)
    out = np.full((len(nt), len(FIT)), np.nan)
    for now, n in _blocks(nt, nl):
        out[now] = _fit(*_padded(now, n, at, t, nl, al, l))
    return out


def _padded(now: np.ndarray, n: int, at: np.ndarray, t: np.ndarray, nl: np.ndarray, al: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = t[at[now, None] + np.arange(n)]
    return own, l[al[now, None] + np.minimum(np.arange(nl[now].max()), nl[now, None] - 1)], nl[now]


def project(track: np.ndarray, line: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nearest segment (the first of equally near ones) for every point: distance, arc length and unit direction (x, y)
    there; and the arc length at every vertex. Shapes as in :func:`_fit`."""
    step = np.diff(line, axis=1)
    length = np.hypot(step[..., 0], step[..., 1])
    arc = np.concatenate([np.zeros((len(line), 1)), np.cumsum(length, axis=1)], axis=1)
    square = np.maximum((step ** 2).sum(-1), 1e-12)[:, None]
    rx, ry = (track[:, :, None, k] - line[:, None, :-1, k] for k in (0, 1))
    vx, vy = step[:, None, :, 0], step[:, None, :, 1]
    u = np.clip((rx * vx + ry * vy) / square, 0.0, 1.0)
    far = (rx - u * vx) ** 2 + (ry - u * vy) ** 2
    far[np.broadcast_to(np.arange(step.shape[1]) >= sizes[:, None, None] - 1, far.shape)] = np.inf
    near = far.argmin(-1)
    pick = lambda a: np.take_along_axis(a, near[..., None], -1)[..., 0]
    of_segment = lambda a: np.take_along_axis(a, near, -1)
    unit = step / np.maximum(length, 1e-12)[..., None]
    s = of_segment(arc) + pick(u) * of_segment(length)
    return np.sqrt(pick(far)), s, of_segment(unit[..., 0]), of_segment(unit[..., 1]), arc


def headings(track: np.ndarray) -> np.ndarray:
    """Unit direction at every point, from its neighbours (at the ends from the one there is)."""
    n = track.shape[1]
    before, after = track[:, np.maximum(np.arange(n) - 1, 0)], track[:, np.minimum(np.arange(n) + 1, n - 1)]
    return (after - before) / np.maximum(np.hypot(*np.moveaxis(after - before, -1, 0)), 1e-9)[..., None]


def _fit(track: np.ndarray, line: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``track``: pairs, points, 2. ``line``: pairs, vertices, 2, of which the first ``sizes`` count."""
    side, s, tx, ty, arc = project(track, line, sizes)
    n, heading = track.shape[1], headings(track)
    dots = heading[..., 0] * tx + heading[..., 1] * ty
    lo, hi = np.quantile(s, [0.02, 0.98], axis=1)
    flat = hi <= lo + 1e-9
    lo, hi = np.where(flat, s.min(1), lo), np.where(flat, s.max(1), hi)
    own = np.concatenate([np.zeros((len(track), 1)), np.cumsum(np.hypot(*np.moveaxis(np.diff(track, axis=1), -1, 0)), axis=1)], axis=1)
    even = np.stack([_at_arcs(p, a, 0.0, a[-1], n) for p, a in zip(track, own)])
    local = np.stack([_at_arcs(p[:k], a[:k], x, y, n) for p, a, k, x, y in zip(line, arc, sizes, lo, hi)])
    extent = hi > lo + 1e-9
    gaps = np.hypot(*np.moveaxis(even - local, -1, 0)).mean(1)
    ahead = (np.diff(s, axis=1) >= -1e-6).mean(1) if n > 1 else np.ones(len(s))
    return np.stack([
        np.where(extent, gaps, np.nan), side.mean(1), np.quantile(side, 0.9, axis=1),
        np.where(extent, _frechet(even[:, ::FRECHET_STEP], local[:, ::FRECHET_STEP]), np.nan),
        dots.mean(1), dots[:, 0], dots[:, -1], ahead], axis=1)


def _at_arcs(points: np.ndarray, arc: np.ndarray, lo: float, hi: float, n: int) -> np.ndarray:
    at = lo + (hi - lo) * np.arange(n) / max(n - 1, 1)
    return np.stack([np.interp(at, arc, points[:, k]) for k in (0, 1)], axis=1)


def _frechet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Discrete Frechet distances of many pairs of lines at once, a row of the table at a time."""
    gaps = np.hypot(a[:, :, None, 0] - b[:, None, :, 0], a[:, :, None, 1] - b[:, None, :, 1])
    row = np.maximum.accumulate(gaps[:, 0], axis=1)
    for i in range(1, gaps.shape[1]):
        reach = np.minimum(row, np.concatenate([row[:, :1], row[:, :-1]], axis=1))
        row = np.empty_like(row)
        row[:, 0] = np.maximum(reach[:, 0], gaps[:, i, 0])
        for j in range(1, gaps.shape[2]):
            row[:, j] = np.maximum(np.minimum(reach[:, j], row[:, j - 1]), gaps[:, i, j])
    return row[:, -1]


def lane_fit(pairs: DataFrame, first: int) -> DataFrame:
    """Puts the fit of the first points (first_mean, first_p90, first_direction, first_monotonic), of all (direction,
    monotonic), and ``_points`` (lateral, dot and advance of every point) in the place of ``track`` and ``line``."""
    kept, names = _kept(pairs)
    points = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in POINT]))
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in LANE], T.StructField("_points", points)])

    def fitted(batches):
        for batch in batches:
            values, each, ends = _lane_batch(batch.column("track"), batch.column("line"), first)
            rows = pa.StructArray.from_arrays([pa.array(v) for v in each.T], list(POINT))
            columns = [batch.column(n) for n in names] + [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in values.T]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), rows)], [*names, *LANE, "_points"])

    return spread(pairs, *names).mapInArrow(fitted, schema)


def _lane_batch(tracks: pa.ListArray, lines: pa.ListArray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of ``LANE`` for each pair, one of ``POINT`` for each point of its track, and where those of a pair end."""
    (nt, at, t), (nl, al, l) = points_of(tracks), points_of(lines)
    out, each = np.full((len(nt), len(LANE)), np.nan), np.full((len(t), len(POINT)), np.nan)
    ahead = lambda s: (np.diff(s, axis=1) >= -1e-6).mean(1) if s.shape[1] > 1 else np.ones(len(s))
    for now, n in _blocks(nt, nl):
        track, line, sizes = _padded(now, n, at, t, nl, al, l)
        side, s, tx, ty, _ = project(track, line, sizes)
        whole, early = headings(track), headings(track[:, :first])
        dots = whole[..., 0] * tx + whole[..., 1] * ty
        early = early[..., 0] * tx[:, :first] + early[..., 1] * ty[:, :first]
        out[now] = np.stack([side[:, :first].mean(1), np.quantile(side[:, :first], 0.9, axis=1), early.mean(1), ahead(s[:, :first]), dots.mean(1), ahead(s)], axis=1)
        advance = (np.diff(s, axis=1, prepend=s[:, :1]) >= -1e-6).astype(float)
        each[at[now, None] + np.arange(n)] = np.stack([side, dots, advance], axis=-1)
    return out, each, np.cumsum(np.append(0, nt)).astype(np.int32)

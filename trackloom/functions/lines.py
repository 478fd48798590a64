"""Resampling of short lines held as arrays, on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

LINE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def points_of(lines: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and first place of every line (a null line has size 0), and the points of all as rows of x and y."""
    sizes = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = lines.flatten()
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    return sizes, np.cumsum(sizes) - sizes, xy


def lines_of(xy: np.ndarray, sizes: np.ndarray, missing: np.ndarray | None = None) -> pa.ListArray:
    ends = pa.array(np.cumsum(np.append(0, sizes)).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(ends, points, mask=None if missing is None else pa.array(missing))


@F.arrow_udf(LINE)
def resample_lines(line: pa.Array, n: pa.Array) -> pa.Array:
    """n points equally spaced by arc length; a line without length repeats its first point.

    Points stay Arrow arrays: as Python objects, those of one batch would take hundreds of megabytes.
    """
    sizes, first, xy = points_of(line)
    wanted = np.where(sizes > 0, n.to_numpy(zero_copy_only=False), 0).astype(np.int64)
    out, end = np.empty((int(wanted.sum()), 2)), np.cumsum(wanted)
    for size, at, k, z in zip(sizes.tolist(), first.tolist(), wanted.tolist(), end.tolist()):
        if not size:
            continue
        p = xy[at : at + size]
        steps = np.hypot(*np.diff(p, axis=0).T) if size > 1 else np.zeros(0)
        keep = np.append(True, steps > 1e-9)
        arc = np.append(0.0, np.cumsum(steps))[keep]
        places = np.linspace(0.0, arc[-1], k)
        for axis in (0, 1):
            out[z - k : z, axis] = np.interp(places, arc, p[keep, axis])
    return lines_of(out, wanted, line.is_null().to_numpy(zero_copy_only=False) if line.null_count else None)

"""Sums of Gaussian kernels over all pairs of points without pairs.

A Gaussian of bandwidth w is, on a period that keeps its images REACH bandwidths away, a sum of cosines with positive
weights (the trapezoidal rule of its Fourier integral). A cosine of a difference is a product of sines and cosines of the
two places, so the kernel is a scalar product of two vectors, and a sum over all pairs of two sets is the scalar product of
their summed vectors. What is left out lies below exp(-REACH**2 / 2), about 4e-17 a pair: the sums are those of all pairs to
the last digits of a double, as if the pairs were added up one by one, and the work grows with the points, not with their
pairs.

An axis whose values span at most WIDE bandwidths is one box. A longer one is cut into boxes of REACH bandwidths, of which
only neighbours meet; three boxes make a period. So a far outlier has a box of its own and costs the others nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from trackloom import constants as K

REACH = 8.7  # bandwidths
WIDE = 32  # bandwidths
TOGETHER = 4096  # points whose vectors a task holds at a time


@dataclass(frozen=True)
class Axis:
    bandwidth: float
    start: float
    period: float
    side: float | None  # of a box; None: one box

    @classmethod
    def over(cls, low: float, high: float, bandwidth: float) -> Axis:
        if high - low <= WIDE * bandwidth:
            return cls(bandwidth, low, high - low + REACH * bandwidth, None)
        return cls(bandwidth, 0.0, 3 * REACH * bandwidth, REACH * bandwidth)

    def boxes(self, values: np.ndarray) -> np.ndarray:
        return np.zeros(len(values), np.int64) if self.side is None else np.floor(values / self.side).astype(np.int64)

    def vectors(self, values: np.ndarray) -> np.ndarray:
        """One row for each value; the scalar product of two rows is the Gaussian of their difference."""
        step = 2 * np.pi / self.period
        waves = np.arange(int(np.ceil(REACH / self.bandwidth / step)) + 1)
        weights = self.bandwidth * np.sqrt(2 * np.pi) / self.period * np.exp(-((self.bandwidth * step * waves) ** 2) / 2)
        weights[1:] *= 2
        turns = np.empty((len(values), len(waves)), complex)
        turns[:, 0] = 1
        turns[:, 1:] = np.exp(1j * step * np.mod(values - self.start, self.period))[:, None]
        turns = np.cumprod(turns, axis=1) * np.sqrt(weights)
        return np.concatenate([turns.real, turns.imag[:, 1:]], axis=1)


@dataclass(frozen=True)
class Levels:
    """The axes of every bandwidth for points within (low x, high x, low y, high y)."""

    axes: tuple[tuple[Axis, Axis], ...]

    @classmethod
    def over(cls, df: DataFrame, xs: list[str], ys: list[str]) -> Levels:
        """For the finite values of the columns of ``df``."""
        finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))
        ends = [f(finite(c)) for cs in (xs, ys) for f in (F.min, F.max) for c in cs]
        row = df.agg(*[e.alias(f"_{i}") for i, e in enumerate(ends)]).first()
        found, at = [], 0
        for cs in (xs, ys):
            for pick in (min, max):
                found.append(pick((v for v in row[at : at + len(cs)] if v is not None), default=0.0))
                at += len(cs)
        return cls(tuple((Axis.over(found[0], found[1], w), Axis.over(found[2], found[3], w)) for w in K.KERNEL_BANDWIDTHS))

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Level, box and summed vector of the points of each box. Points that are not finite make it not a number."""
        good = np.isfinite(x) & np.isfinite(y)
        for level, (of_x, of_y) in enumerate(self.axes):
            out: dict[tuple[int, int], np.ndarray] = {}
            for at in range(0, len(x), TOGETHER):
                here = np.flatnonzero(good[at : at + TOGETHER]) + at
                bx, by = of_x.boxes(x[here]), of_y.boxes(y[here])
                left, right = of_x.vectors(x[here]) * weight[here, None], of_y.vectors(y[here])
                order = np.lexsort((by, bx))
                cuts = np.flatnonzero((np.diff(bx[order]) != 0) | (np.diff(by[order]) != 0)) + 1
                for part in np.split(order, cuts) if len(order) else ():
                    box, one = (int(bx[part[0]]), int(by[part[0]])), len(part) == len(order)
                    total = (left.T @ right if one else left[part].T @ right[part]).ravel()
                    out[box] = out[box] + total if box in out else total
            if not good.all():
                out[0, 0] = np.full(of_x.vectors(np.zeros(1)).size * of_y.vectors(np.zeros(1)).size, np.nan)
            for (i, j), total in out.items():
                yield level, i, j, total

    def neighbours(self, level: int) -> list[tuple[int, int]]:
        """The boxes that meet a box, as steps from it."""
        of_x, of_y = self.axes[level]
        return [(i, j) for i in ((0,) if of_x.side is None else (-1, 0, 1)) for j in ((0,) if of_y.side is None else (-1, 0, 1))]

    def met(self, level: Column) -> Column:
        """``neighbours`` as a column: structs i, j."""
        one = lambda steps: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
        return F.element_at(F.array(*[one(self.neighbours(k)) for k in range(len(self.axes))]), level.cast("int") + 1)

"""Local polynomial (Savitzky-Golay) weights and the per-block numeric helper."""

from __future__ import annotations

from functools import lru_cache
from math import factorial

import numpy as np


def odd_window(n: int, preferred: int, poly: int, strict: bool = False) -> int | None:
    """Largest odd window up to ``preferred`` that fits ``n`` rows; None if too short for ``poly``."""
    if n <= poly + (1 if strict else 0):
        return None
    win = min(preferred, n if n % 2 else n - 1)
    return win if win > poly else None


@lru_cache(maxsize=256)
def weights(win: int, poly: int, deriv: int) -> np.ndarray:
    """``weights[p] @ block`` is the ``deriv``-th derivative at row p of the polynomial fitted to the block."""
    t = np.arange(win, dtype=float) - (win - 1) / 2
    fit = np.linalg.pinv(np.vander(t, poly + 1, increasing=True))
    powers = np.zeros((win, poly + 1))
    for k in range(deriv, poly + 1):
        powers[:, k] = factorial(k) / factorial(k - deriv) * t ** (k - deriv)
    return powers @ fit


def smooth(values: np.ndarray, first: int, total: int, win: int, poly: int, deriv: int = 0, delta: float = 1.0):
    """Smooth a stretch of a longer series.

    ``values`` holds rows ``first .. first+len-1`` of a series of ``total`` rows. Rows whose fitting block
    is not fully inside the stretch come back as NaN.
    """
    n = len(values)
    w = weights(win, poly, deriv)
    half = win // 2
    start = np.clip(np.arange(first, first + n) - half, 0, total - win)
    at = np.arange(first, first + n) - start
    rel = start - first
    ok = (rel >= 0) & (rel + win <= n)
    out = np.full(n, np.nan)
    if ok.any():
        blocks = np.lib.stride_tricks.sliding_window_view(values, win)
        out[ok] = np.einsum("ij,ij->i", blocks[rel[ok]], w[at[ok]])
    return out / delta**deriv


def gradient(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.gradient(values, at) if len(values) > 1 else np.zeros_like(values)

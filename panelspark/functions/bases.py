"""Harmonic and natural-spline regression bases."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col


def harmonics(col: Column | str, nfreq: int, period: float) -> list[Column]:
    """sin terms for k = 1..nfreq, then the cos terms."""
    c = as_col(col)
    angles = [c * F.lit(2.0 * math.pi * k / period) for k in range(1, nfreq + 1)]
    return [F.sin(a) for a in angles] + [F.cos(a) for a in angles]


def natural_spline_basis(col: Column | str, knots: Sequence[float]) -> list[Column]:
    """Natural cubic basis over `knots` (boundary knots first and last), len(knots)-1 columns.

    Truncated powers on the range scaled to [0, 1]; linear beyond the boundary knots.
    """
    lo, hi = float(knots[0]), float(knots[-1])
    if not hi > lo:
        raise ValueError("the boundary knots coincide: the column is constant")
    x = (as_col(col) - F.lit(lo)) / F.lit(hi - lo)
    ks = [(k - lo) / (hi - lo) for k in knots]
    if any(b <= a for a, b in zip(ks, ks[1:])):
        raise ValueError(f"knots must ascend strictly: {list(knots)}")

    def ramp(k: float) -> Column:
        d = x - F.lit(k)
        return F.when(d > 0, d * d * d).when(d <= 0, F.lit(0.0))

    def scaled(k: float) -> Column:
        return (ramp(k) - ramp(1.0)) / F.lit(1.0 - k)

    last = scaled(ks[-2])
    return [x] + [scaled(k) - last for k in ks[:-2]]

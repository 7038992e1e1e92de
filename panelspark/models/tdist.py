"""Student-t and normal tail areas for coefficient tables (a handful of numbers on the driver)."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated front to back."""
    floor = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), floor)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > floor else floor)
            c = c if abs(c) > floor else floor
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(stat: float, df: float | None) -> float:
    """P(|T| > |stat|); `df=None` is the normal distribution."""
    if df is None:
        return math.erfc(abs(stat) / math.sqrt(2.0))
    return beta_cdf(df / 2.0, 0.5, df / (df + stat * stat))


def t_quantile(level: float, df: float | None) -> float:
    """The q with P(|T| <= q) = level, by bisection."""
    lo, hi = 0.0, 1.0
    while two_sided_p(hi, df) > 1.0 - level:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if two_sided_p(mid, df) > 1.0 - level else (lo, mid)
    return (lo + hi) / 2.0

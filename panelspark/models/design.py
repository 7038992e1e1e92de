"""Design columns: numeric terms, factors, splines and harmonics, standardised for the sums."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import harmonics, natural_spline_basis
from ..operators.ranks import exact_quantiles

MAX_LEVELS = 500
ROWS_PER_TASK = 20_000
INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Factor:
    """Dummy columns for every level but `base` (the smallest when not given)."""

    col: str
    base: object = None
    levels: Sequence | None = None

    def columns(self, df: DataFrame) -> list[tuple[str, Column]]:
        levels = self.levels
        if levels is None:
            found = df.select(self.col).filter(F.col(self.col).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
            if len(found) > MAX_LEVELS:
                raise ValueError(f"{self.col} has over {MAX_LEVELS} levels: absorb it instead of coding dummies")
            levels = sorted(r[0] for r in found)
        if not levels:
            raise ValueError("no complete rows to fit")
        base = levels[0] if self.base is None else self.base
        if base not in levels:
            raise ValueError(f"base level {base!r} does not occur in {self.col}")
        c = F.col(self.col)
        return [(f"{self.col}{v}", (c == F.lit(v)).cast("double")) for v in levels if v != base]


@dataclass(frozen=True)
class Spline:
    """Natural cubic spline with `df` columns; inner knots at quantiles, boundary knots at the range."""

    col: str
    df: int = 2
    knots: Sequence[float] | None = None

    def columns(self, df: DataFrame) -> list[tuple[str, Column]]:
        knots = self.knots
        if knots is None:
            probs = [i / self.df for i in range(self.df + 1)]
            knots = list(exact_quantiles(df, self.col, probs, names=[f"k{i}" for i in range(len(probs))]).head())
        basis = natural_spline_basis(self.col, knots)
        return [(f"ns({self.col})_{i}", b) for i, b in enumerate(basis, 1)]


@dataclass(frozen=True)
class Harmonic:
    col: str
    nfreq: int = 2
    period: float = 12

    def columns(self, df: DataFrame) -> list[tuple[str, Column]]:
        cols = harmonics(self.col, self.nfreq, self.period)
        kinds = [("sin", k) for k in range(1, self.nfreq + 1)] + [("cos", k) for k in range(1, self.nfreq + 1)]
        return [(f"{f}{k}({self.col})", c) for (f, k), c in zip(kinds, cols)]


Term = str | Factor | Spline | Harmonic


@dataclass
class Design:
    """Rows complete in every model variable, with `__y`, `__w`, `__off`, `__one`, `__x<i>` added.

    `__x<i>` is centred and scaled (constants are left as they are); `back` maps standardised
    coefficients, intercept first if there is one, to the original scale.
    """

    data: DataFrame
    names: list[str]
    xcols: list[str]
    back: np.ndarray
    shift_y: float
    n: int
    weighted: bool
    offset: bool
    mean_weight: float = 1.0
    owned: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for d in self.owned:
            d.unpersist()


def present(df: DataFrame, col: str) -> Column:
    """Neither null nor NaN."""
    there = F.col(col).isNotNull()
    return there & ~F.isnan(col) if dict(df.dtypes).get(col) in ("double", "float") else there


def build_design(
    df: DataFrame, y: str, terms: Sequence[Term], intercept: bool = True, weights: str | None = None,
    offset: str | None = None, center_y: bool = False, cache: bool = True, absorb: str | tuple[str, str] | None = None,
) -> Design:
    """Rows that miss the outcome, a term, the weight, the offset or the absorbed group are left out; NaN is missing.

    `cache=False` reads the input anew in each pass, which is right for a plain table scan.
    """
    owned = []
    if cache and not df.is_cached:
        df = df.persist()  # read several times: knots, means, sums, residuals
        owned.append(df)
    sets = [absorb] if isinstance(absorb, str) else list(absorb or [])
    inputs = [y] + [t if isinstance(t, str) else t.col for t in terms] + [c for c in (weights, offset, *sets) if c]
    df = df.filter(reduce(and_, [present(df, c) for c in dict.fromkeys(inputs)]))
    pairs: list[tuple[str, Column]] = []
    for t in terms:
        pairs += [(t, F.col(t).cast("double"))] if isinstance(t, str) else t.columns(df)
    if len({n for n, _ in pairs}) != len(pairs):
        raise ValueError("a term is listed twice")
    stats = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("ybar"), F.avg(weights or F.lit(1.0)).alias("wbar"),
        *[F.avg(c).alias(f"m{i}") for i, (_, c) in enumerate(pairs)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, (_, c) in enumerate(pairs)],
    ).head()
    if not stats["n"]:
        raise ValueError("no complete rows to fit")
    m = np.array([stats[f"m{i}"] for i in range(len(pairs))], dtype=float)
    s = np.array([stats[f"s{i}"] for i in range(len(pairs))], dtype=float)
    s = np.where(s > 1e-12 * np.maximum(1.0, np.abs(m)), s, 1.0)
    shift_y = float(stats["ybar"]) if center_y else 0.0
    xcols = [f"__x{i}" for i in range(len(pairs))]
    added = {x: (c - F.lit(float(mi))) / F.lit(float(si)) for x, (_, c), mi, si in zip(xcols, pairs, m, s)}
    added["__y"] = F.col(y).cast("double") - F.lit(shift_y)
    added["__one"] = F.lit(1.0)
    # Mean weight one keeps the sums well scaled; coefficients and CR2 errors do not depend on it.
    added["__w"] = F.col(weights).cast("double") / F.lit(float(stats["wbar"])) if weights else F.lit(1.0)
    added["__off"] = F.col(offset).cast("double") if offset else F.lit(0.0)
    data = df.select("*", *[c.alias(n) for n, c in added.items()])
    # A small panel in hundreds of shuffle partitions would pay for a task each in every round;
    # with more rows than this fills, it changes nothing.
    data = data.coalesce(-(-int(stats["n"]) // ROWS_PER_TASK))
    names = [n for n, _ in pairs]
    back = np.diag(1.0 / s)
    if intercept:
        back = np.block([[np.ones((1, 1)), -(m / s)[None, :]], [np.zeros((len(pairs), 1)), back]])
        names, xcols = [INTERCEPT, *names], ["__one", *xcols]
    return Design(
        data, names, xcols, back, shift_y, int(stats["n"]), weights is not None, offset is not None,
        float(stats["wbar"]), owned,
    )


def linear_predictor(xcols: Sequence[str], b: np.ndarray) -> Column:
    return F.expr(" + ".join(["0D", *[f"`{x}` * {float(v)!r}D" for x, v in zip(xcols, b)]]))


def drop_aliased(gram: np.ndarray, tol: float = 1e-9, floor: float = 0.0) -> list[int]:
    """Columns to keep, in term order: one is dropped when the kept ones before it reproduce it, or when its own sum of
    squares is at most `floor`."""
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    kept: list[int] = []
    for j in range(len(gram)):
        if scale[j] ** 2 <= floor:
            continue
        if kept:
            corr = gram[np.ix_(kept, kept)] / np.outer(scale[kept], scale[kept])
            g = gram[kept, j] / (scale[kept] * scale[j])
            left = 1.0 - g @ np.linalg.solve(corr, g)
            if left <= tol:
                continue
        kept.append(j)
    return kept

"""Least squares, weighted least squares and variance inflation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .design import INTERCEPT, Term, build_design, drop_aliased, present
from .fit import Fit
from .moments import moments, symmetric, within_sums
from .twoway import two_way_sums


def ols(
    df: DataFrame, y: str, terms: Sequence[Term], weights: str | None = None, absorb: str | tuple[str, str] | None = None, cache: bool = True
) -> Fit:
    """Linear model from one cross-product aggregation.

    `absorb` takes out one set of group effects without coding dummies, whatever their number: the
    within-group cross products come from per-group sums, never from demeaned rows. Two sets, such as
    areas and periods, leave together; one of them may have any number of levels.
    """
    d = build_design(df, y, terms, intercept=absorb is None, weights=weights, center_y=True, cache=cache, absorb=absorb)
    if absorb is None:
        k = len(d.xcols) + 1
        row = moments(d.data, [*d.xcols, "__y"], "__w" if weights else None).head()["m"]
        full = symmetric(row, k)
        groups = 0
    elif not isinstance(absorb, str):
        full, groups = two_way_sums(d, tuple(absorb), weights is not None)
    else:
        k = len(d.xcols) + 2
        per_group = moments(d.data, ["__one", *d.xcols, "__y"], "__w" if weights else None, by=[absorb])
        full, _, (groups,) = within_sums(per_group.withColumn("__g", F.lit(1.0)), k, extra=["__g"])
        groups = int(groups)
    gram, xty, yty = full[:-1, :-1], full[:-1, -1], full[-1, -1]
    kept = drop_aliased(gram, floor=0.0 if absorb is None or isinstance(absorb, str) else 1e-9 * d.n)
    bread = np.linalg.inv(gram[np.ix_(kept, kept)])
    coef = bread @ xty[kept]
    rss = max(float(yty - coef @ xty[kept]), 0.0)
    df_resid = d.n - len(kept) - groups
    sigma2 = rss / df_resid if df_resid > 0 else float("nan")
    stats = {"sigma": (sigma2 * d.mean_weight) ** 0.5, "rss": rss * d.mean_weight, "groups": groups}
    if absorb is None and d.names[0] == INTERCEPT:
        tss = float(yty - xty[0] ** 2 / gram[0, 0])
    else:
        tss = float(yty)
    if tss > 0:
        stats["r2"] = 1.0 - rss / tss
    again = lambda c: ols(df.filter(present(df, c)), y, terms, weights, absorb, cache)
    return Fit("gaussian", d, kept, coef, bread, sigma2, df_resid, absorb=absorb, stats=stats, again=again)


def wls(df: DataFrame, y: str, terms: Sequence[Term], weights: str, absorb: str | tuple[str, str] | None = None) -> Fit:
    return ols(df, y, terms, weights=weights, absorb=absorb)


def vif(df: DataFrame, cols: Sequence[str], cache: bool = True) -> DataFrame:
    """Variance inflation of each regressor: the diagonal of the inverse correlation matrix."""
    d = build_design(df, cols[0], list(cols), cache=cache)
    k = len(cols) + 1
    g = symmetric(moments(d.data, d.xcols).head()["m"], k)
    cov = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
    sd = np.sqrt(np.diag(cov))
    inv = np.linalg.inv(cov / np.outer(sd, sd))
    d.release()
    rows = [(c, float(v)) for c, v in zip(cols, np.diag(inv))]
    return df.sparkSession.createDataFrame(rows, "term string, vif double")

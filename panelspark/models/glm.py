"""Quasi-Poisson regression with a log link and an offset, dummies coded in the design."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .design import Term, build_design, drop_aliased, linear_predictor, present
from .fit import Fit
from .moments import moments, symmetric


def poisson_glm(
    df: DataFrame, y: str, terms: Sequence[Term], offset: str | None = None, quasi: bool = True,
    tol: float = 1e-7, max_iter: int = 50,
) -> Fit:
    """Iteratively reweighted least squares; each round is one aggregation over the same cached rows.

    A round's plan holds the last coefficients as literals, so plans do not grow.
    """
    d = build_design(df, y, terms, offset=offset)
    x, kept, coef = d.xcols, None, None
    for _ in range(max_iter):
        if coef is None:
            mu = F.col("__y") + F.lit(0.1)
            eta = F.log(mu)
        else:
            eta = linear_predictor([x[i] for i in kept], coef) + F.col("__off")
            mu = F.exp(eta)
        work = d.data.select(
            *x, mu.alias("__mu"), (eta - F.col("__off") + (F.col("__y") - mu) / mu).alias("__z")
        )
        g = symmetric(moments(work, [*x, "__z"], "__mu").head()["m"], len(x) + 1)
        if kept is None:
            kept = drop_aliased(g[:-1, :-1])
        bread = np.linalg.inv(g[np.ix_(kept, kept)])
        new = bread @ g[kept, -1]
        done = coef is not None and np.max(np.abs(new - coef)) < tol * (1.0 + np.max(np.abs(new)))
        coef = new
        if done:
            break
    else:
        raise ArithmeticError(f"no convergence in {max_iter} rounds")
    mu = F.exp(linear_predictor([x[i] for i in kept], coef) + F.col("__off"))
    yc = F.col("__y")
    dev = F.when(yc > 0, yc * F.log(yc / mu)).otherwise(F.lit(0.0)) - (yc - mu)
    s = d.data.agg(F.sum((yc - mu) * (yc - mu) / mu).alias("x2"), (2 * F.sum(dev)).alias("dev")).head()
    df_resid = d.n - len(kept)
    phi = s["x2"] / df_resid if quasi else 1.0
    again = lambda c: poisson_glm(df.filter(present(df, c)), y, terms, offset, quasi, tol, max_iter)
    stats = {"deviance": s["dev"], "pearson": s["x2"]}
    return Fit("poisson", d, kept, coef, bread, phi, df_resid, normal=not quasi, stats=stats, again=again)


def poisson_groups(rows: DataFrame, group: str, mean: Column) -> tuple[DataFrame, Row]:
    """(group, __alpha), the effects in closed form given the rest of the mean, and the fit's sums over these groups:
    x2 (Pearson), half_dev, n, dropped (groups whose outcome sums to zero, which have no effect)."""
    yc = F.col("__y")
    per = rows.groupBy(group).agg(
        F.sum(yc).alias("__Y"), F.sum(mean).alias("__E"), F.sum(yc * yc / mean).alias("__q"), F.count(F.lit(1)).alias("__n"),
        F.sum(F.when(yc > 0, yc * (F.log(yc) - F.log(mean))).otherwise(F.lit(0.0))).alias("__dv"),
    )
    informative, factor = F.col("__Y") > 0, F.col("__Y") / F.col("__E")
    sums = per.agg(
        F.sum(F.when(informative, F.col("__q") / factor - F.col("__Y"))).alias("x2"),
        F.sum(F.when(informative, F.col("__dv") - F.col("__Y") * F.log(factor))).alias("half_dev"),
        F.sum(F.when(informative, F.col("__n"))).alias("n"),
        F.count_if(~informative).alias("dropped"),
    ).head()
    return per.filter(informative).select(group, F.log(factor).alias("__alpha")), sums

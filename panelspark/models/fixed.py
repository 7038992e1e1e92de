"""Regressions with one absorbed set of group effects (persons), any number of groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Owned
from .design import Term, build_design, drop_aliased, linear_predictor, present
from .fit import Fit
from .glm import poisson_groups
from .moments import triangle_pairs, within_sums
from .spread import spread_rows
from .twoway import poisson_two_way


#: Distance of the predictors of a group's zeros and ones beyond which the group counts as separated.
SPLIT = 30.0


def fe_poisson(
    df: DataFrame, y: str, terms: Sequence[Term], absorb: str | tuple[str, str], offset: str | None = None,
    tol: float = 1e-7, max_iter: int = 50,
) -> Fit:
    """Quasi-Poisson with one or two sets of absorbed group effects.

    Given the slopes, a group's effect is log(sum y / sum exp(x b)), so Newton steps on the slopes need
    only per-group sums: no effect column is ever joined to the rows while iterating, and rows are
    shuffled once. Groups whose
    outcome sums to zero carry no information on the slopes; they are left out and counted.
    """
    d = build_design(df, y, terms, intercept=False, offset=offset, absorb=absorb)
    again = lambda c: fe_poisson(df.filter(present(df, c)), y, terms, absorb, offset, tol, max_iter)
    if not isinstance(absorb, str):
        f = poisson_two_way(d, tuple(absorb), tol, max_iter)
        d.n = f.n
        df_resid = d.n - len(f.kept) - f.groups
        stats = {"deviance": 2 * f.sums["half_dev"], "pearson": f.sums["x2"], "groups": f.groups, "groups_dropped": f.dropped}
        return Fit("poisson", d, f.kept, f.coef, f.bread, f.sums["x2"] / df_resid, df_resid, absorb=tuple(absorb), effects=f.effects, stats=stats, again=again)
    x, p = d.xcols, len(d.xcols)
    spread = spread_rows(d.data.select(absorb, "__one", *x, "__y", "__off"), absorb, d.n)
    sums = spread.rows.agg(*[F.sum(F.col("__y") * F.col(c)).alias(c) for c in x]).head()
    sxy = np.array([sums[c] for c in x], dtype=float)
    n_pairs = len(triangle_pairs(p + 1))

    def evaluate(b: np.ndarray):
        e = F.exp(linear_predictor(x, b) + F.col("__off"))
        g = spread.select("__one", *x, "__y", e.alias("__e")).group_moments(["__one", *x], "__e", extra=["__y"])
        total = f"m[{n_pairs}]"
        g = g.filter(f"{total} > 0").selectExpr("m", f"{total} / m[0] AS __s", f"{total} * ln(m[0]) AS __ll", "1D AS __g")
        hess, mean, (log_norm, groups) = within_sums(g, p + 1, scale="__s", extra=["__ll", "__g"])
        return float(sxy @ b - log_norm), sxy - mean, hess, int(groups)

    b, kept = np.zeros(p), None
    ll, grad, hess, groups = evaluate(b)
    for _ in range(max_iter):
        if kept is None:
            kept = drop_aliased(hess)
        step = np.zeros(p)
        step[kept] = np.linalg.solve(hess[np.ix_(kept, kept)], grad[kept])
        for _ in range(30):  # halve until the likelihood does not fall
            new_ll, new_grad, new_hess, groups = evaluate(b + step)
            if new_ll >= ll - 1e-9 * (1.0 + abs(ll)):
                break
            step /= 2.0
        else:
            raise ArithmeticError("no step along the slope raises the likelihood")
        b, ll, grad, hess = b + step, new_ll, new_grad, new_hess
        if np.max(np.abs(step)) < tol * (1.0 + np.max(np.abs(b))):
            break
    else:
        raise ArithmeticError(f"no convergence in {max_iter} rounds")

    effects, s = poisson_groups(d.data, absorb, F.exp(linear_predictor(x, b) + F.col("__off")))
    spread.release()
    d.n = int(s["n"])
    df_resid = d.n - len(kept) - groups
    stats = {"deviance": 2 * s["half_dev"], "pearson": s["x2"], "groups": groups, "groups_dropped": s["dropped"]}
    return Fit(
        "poisson", d, kept, b[kept], np.linalg.inv(hess[np.ix_(kept, kept)]), s["x2"] / df_resid, df_resid,
        absorb=absorb, effects=effects, stats=stats, again=again,
    )


def fe_logit(
    df: DataFrame, y: str, terms: Sequence[Term], absorb: str, tol: float = 1e-7, max_iter: int = 100,
) -> Fit:
    """Logit with a free effect per group (not the conditional likelihood).

    Slopes and effects move together in Newton steps; the effects are eliminated group by group from per-group sums. A step
    is halved until the likelihood does not fall; the trial points lie on one line, so halving needs no new effects table.

    Groups whose outcome never varies have no finite effect; they are left out and counted (`groups_dropped`). So are groups
    whose outcomes the predictor comes to split by more than `SPLIT` (`groups_separated`): their part of the likelihood
    only rises on the way to infinity. A term that only such groups inform on is then dropped as collinear. If the
    predictor splits every group there is no finite estimate, which is an error.
    """
    d = build_design(df, y, terms, intercept=False, absorb=absorb)
    x, p = d.xcols, len(d.xcols)
    spark = df.sparkSession
    yc = F.col("__y")
    groups_all = d.data.groupBy(absorb).agg(
        F.avg(yc).alias("ybar"), F.min(yc).alias("lo"), F.max(yc).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    varies = F.col("lo") < F.col("hi")
    c = groups_all.agg(
        F.count_if(varies).alias("kept"), F.count_if(~varies).alias("dropped"), F.sum(F.when(varies, F.col("n"))).alias("n")
    ).head()
    if not c["kept"]:
        raise ValueError("the outcome varies in no group")
    d.n = int(c["n"])
    tables = [Owned(spark, "fixed-effects"), Owned(spark, "fixed-effects")]  # the effects, and those of the next step
    effects = tables[0].write(groups_all.filter(varies).select(absorb, F.log(F.col("ybar") / (1 - F.col("ybar"))).alias("__alpha")))
    spread = spread_rows(d.data.select(absorb, "__one", *x, "__y"), absorb, d.n)
    n_pairs = len(triangle_pairs(p + 2))
    ends = spread.rows.agg(*[F.max(c) - F.min(c) for c in x]).head() if p else ()
    widths = np.array([w or 0.0 for w in ends], float)

    def evaluate(b: np.ndarray, effects: DataFrame, alpha: Column) -> DataFrame:
        """Per group: weighted cross products of the constant, x and the working response, likelihood, separation."""
        eta = alpha + linear_predictor(x, b)
        pr = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        w = F.greatest(pr * (1 - pr), F.lit(1e-12))
        side = F.when(yc > 0.5, eta).otherwise(-eta)
        ll = -(F.log1p(F.exp(-F.abs(side))) + F.greatest(-side, F.lit(0.0)))
        rows = spread.join_groups(effects).select("__one", *x, "__y", w.alias("__v"), (eta + (yc - pr) / w).alias("__z"), ll.alias("__ll"), eta.alias("__eta"))
        g = rows.group_moments(["__one", *x, "__z"], "__v", extra=["__ll"]).withColumns({"__ll": F.expr(f"m[{n_pairs}]"), "__g": F.lit(1.0)})
        if np.abs(b) @ widths <= SPLIT:  # no group's predictor can be wider
            return g.withColumn("__apart", F.lit(0.0)).persist()
        low, high = F.min(F.when(yc > 0.5, F.col("__eta"))), F.max(F.when(yc < 0.5, F.col("__eta")))
        gap = rows.rows.groupBy(absorb).agg((low - high).alias("__gap"))
        return g.join(gap, absorb).withColumn("__apart", (F.col("__gap") > SPLIT).cast("double")).persist()

    def totals(g: DataFrame) -> tuple[np.ndarray, np.ndarray, float, int, int]:
        full, _, (ll, n, apart) = within_sums(g, p + 2, extra=["__ll", "__g", "__apart"])
        return full[:p, :p], full[:p, p], float(ll), int(n), int(apart)

    b, kept, separated = np.zeros(p), None, 0
    g = evaluate(b, effects, F.col("__alpha"))
    hess, rhs, ll, groups, gone = totals(g)
    try:
        for _ in range(max_iter):
            if gone:
                separated, kept = separated + gone, None
                if gone == groups:
                    raise ValueError("the predictor splits the outcomes of every group: there is no finite estimate")
                effects = tables[1].write(effects.join(g.filter("__apart > 0").select(absorb), absorb, "left_anti"))
                tables.reverse()
                g.unpersist()
                g = evaluate(b, effects, F.col("__alpha"))
                hess, rhs, ll, groups, _ = totals(g)
            if kept is None:
                kept = drop_aliased(hess, floor=1e-9 * d.n)
            new = np.zeros(p)
            new[kept] = np.linalg.solve(hess[np.ix_(kept, kept)], rhs[kept])
            # Back substitution of each effect, which also takes over what a dropped term added; one row per group.
            left = " - ".join([f"m[{p + 1}]", *[f"m[{1 + i}] * ({float(new[i])!r}D)" for i in range(p)]])
            full = tables[1].write(g.select(absorb, F.expr(f"({left}) / m[0]").alias("__alpha")))
            g.unpersist()
            g, factor = evaluate(new, full, F.col("__alpha")), 1.0
            found = totals(g)
            while not found[2] >= ll - 1e-9 * (1.0 + abs(ll)):
                if factor == 1.0:
                    line = effects.join(full.withColumnRenamed("__alpha", "__full"), absorb)
                factor /= 2.0
                if factor < 1e-9:
                    raise ArithmeticError("no step along the slope raises the likelihood")
                g.unpersist()
                moved = F.col("__alpha") + F.lit(factor) * (F.col("__full") - F.col("__alpha"))
                g = evaluate(b + factor * (new - b), line, moved)
                found = totals(g)
            if factor < 1.0:
                third = Owned(spark, "fixed-effects")
                full = third.write(line.select(absorb, moved.alias("__alpha")))
                tables[1].release()
                tables[1] = third
            tables.reverse()
            change, rise = np.max(np.abs(new - b), initial=0.0), found[2] - ll
            b, effects, (hess, rhs, ll, groups, gone) = b + factor * (new - b), full, found
            if factor == 1.0 and change < tol * (1.0 + np.max(np.abs(b), initial=0.0)) and rise < tol * (1.0 + abs(ll)):
                break
        else:
            raise ArithmeticError(f"no convergence in {max_iter} rounds")
    finally:
        g.unpersist()
        spread.release()
        tables[1].release()
    if separated:
        left_rows = d.data.join(effects.select(absorb), absorb, "left_semi").agg(F.count(F.lit(1)).alias("n")).head()
        d.n = int(left_rows["n"])
    stats = {"deviance": -2 * ll, "groups": groups, "groups_dropped": c["dropped"], "groups_separated": separated}
    return Fit(
        "binomial", d, kept, b[kept], np.linalg.inv(hess[np.ix_(kept, kept)]), 1.0, d.n - len(kept) - groups,
        normal=True, absorb=absorb, effects=effects, stats=stats, owned=[tables[0]],
        again=lambda c: fe_logit(df.filter(present(df, c)), y, terms, absorb, tol, max_iter),
    )

"""Two absorbed sets of effects, such as areas and calendar periods, eliminated without coding dummies of the larger set.

Rows enter as cross products per cell (a level of each set). Within a level of the larger set its effect leaves by a Schur
complement, as with one set; what remains couples the levels of the smaller set only: a matrix whose side is their number,
summed over the larger set's levels. That system is solved exactly, so there are no rounds of alternating projections and
no convergence to watch. Its zero pattern gives the connected sets: every one of them costs one degree of freedom less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .design import Design, drop_aliased, linear_predictor
from .glm import poisson_groups
from .moments import moments, sum_vectors, symmetric, triangle_at, triangle_pairs
from .spread import spread_rows

#: Levels of the smaller set: its matrix has their number squared, 32 MB at most.
MAX_LEVELS = 2000
LEVEL = "__level"


@dataclass
class System:
    """Cross products after the larger set's effects are out: of the columns, of the levels with them, of the levels."""

    columns: np.ndarray
    mixed: np.ndarray  # levels x columns
    levels: np.ndarray
    column_sums: np.ndarray
    level_sums: np.ndarray
    extra: np.ndarray

    def connected(self) -> np.ndarray:
        """A number per level, equal for levels that the larger set's levels connect."""
        n = len(self.levels)
        root = np.arange(n)
        scale = np.sqrt(np.maximum(np.diag(self.levels), 0.0))
        linked = np.abs(self.levels) > 1e-12 * np.outer(scale, scale)
        seen = np.zeros(n, bool)
        for start in range(n):
            if seen[start]:
                continue
            front = np.array([start])
            seen[start] = True
            while len(front):
                root[front] = start
                front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
                seen[front] = True
        return root

    def free(self) -> np.ndarray:
        """Levels that get an effect of their own: all but the first of each connected set."""
        return np.flatnonzero(self.connected() != np.arange(len(self.levels)))

    def both_out(self) -> np.ndarray:
        """Cross products of the columns after both sets of effects are out."""
        at = self.free()
        if not len(at):
            return self.columns
        return self.columns - self.mixed[at].T @ np.linalg.solve(self.levels[np.ix_(at, at)], self.mixed[at])


def order_sets(data: DataFrame, sets: tuple[str, str]) -> tuple[str, str, DataFrame]:
    """The larger set, the smaller one, and the smaller one's levels with a number (one row per level)."""
    n = data.agg(*[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(sets)]).head()
    large, small = sets if n["n0"] >= n["n1"] else sets[::-1]
    most = min(n["n0"], n["n1"])
    if most > MAX_LEVELS:
        raise ValueError(f"both absorbed sets have over {MAX_LEVELS} levels")
    levels = data.select(small).distinct().withColumn(LEVEL, F.row_number().over(Window.orderBy(small)) - 1)
    return large, small, levels


def eliminate(cells: DataFrame, large: str, k: int, n_levels: int, factor: Column | None = None, extra: tuple[str, ...] = ()) -> System:
    """Sum over the larger set's levels of what is left of their cells' cross products.

    `cells` has (large, LEVEL, m) with m the triangle of [constant, k - 1 columns], then any plain sums. `factor` scales a
    level's share, from the whole level's `m`; levels where it is null or not positive are left out. `extra` are columns of
    the whole level's `m` to add up as they are (expressions).
    """
    width = k * (k + 1) // 2
    first = [triangle_at(0, i, k) for i in range(1, k)]
    sums = F.array(*[F.col("m")[i] for i in [0, *first]])
    # a level of the larger set is one row, as long as the smaller set's calendar
    groups = cells.groupBy(large).agg(F.collect_list(F.struct(F.col(LEVEL).alias("at"), sums.alias("s"))).alias("cells"))
    whole = sum_vectors(cells.select(large, "m"), "m", [large])
    whole = whole.withColumn("factor", F.lit(1.0) if factor is None else factor).filter("factor > 0 and m[0] > 0")
    rows = groups.join(whole, large).select(
        F.col("cells.at").alias("at"), F.flatten(F.col("cells.s")).alias("s"), "m", "factor", F.array(*[F.expr(e) for e in extra]).cast("array<double>").alias("extra")
    )
    sizes = [(k - 1) ** 2, n_levels * (k - 1), n_levels**2, k - 1, n_levels, len(extra)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, c, d, e, f = (np.zeros(n) for n in sizes)
        a, b, c = a.reshape(k - 1, k - 1), b.reshape(n_levels, k - 1), c.reshape(n_levels, n_levels)
        for pdf in batches:
            for at, s, m, scale, more in zip(pdf["at"], pdf["s"], pdf["m"], pdf["factor"], pdf["extra"]):
                at, s = np.asarray(at, int), np.asarray(s, float).reshape(len(at), k)
                full = symmetric(m[:width], k)
                weight, mean = s[:, 0], full[0, 1:] / full[0, 0]
                a += scale * (full[1:, 1:] - np.outer(full[0, 1:], mean))
                b[at] += scale * (s[:, 1:] - np.outer(weight, mean))
                c[np.ix_(at, at)] -= scale * np.outer(weight, weight) / full[0, 0]
                c[at, at] += scale * weight
                d += scale * full[0, 1:]
                e[at] += scale * weight
                f += np.asarray(more, float)
        yield pd.DataFrame({"m": [np.concatenate([a.ravel(), b.ravel(), c.ravel(), d, e, f]).tolist()]})

    total = sum_vectors(rows.mapInPandas(run, "m array<double>"), "m").head()
    if total is None or total["m"] is None:
        raise ValueError("no complete rows to fit")
    a, b, c, d, e, f = np.split(np.asarray(total["m"], float), np.cumsum(sizes)[:-1])
    return System(a.reshape(k - 1, k - 1), b.reshape(n_levels, k - 1), c.reshape(n_levels, n_levels), d, e, f)


def two_way_sums(d: Design, sets: tuple[str, str], weighted: bool) -> tuple[np.ndarray, int]:
    """Cross products of x and y after both sets' effects are out, and the effects' degrees of freedom."""
    large, small, levels = order_sets(d.data, sets)
    n_levels = levels.count()
    numbered = d.data.join(F.broadcast(levels), small)  # MAX_LEVELS rows at most
    k = len(d.xcols) + 2
    cells = moments(numbered, ["__one", *d.xcols, "__y"], "__w" if weighted else None, by=[large, LEVEL])
    s = eliminate(cells, large, k, n_levels, extra=("1D",))
    return s.both_out(), int(s.extra[0]) + len(s.free())


@dataclass
class TwoWayPoisson:
    coef: np.ndarray
    kept: list[int]
    bread: np.ndarray
    effects: list[DataFrame]
    groups: int
    n: int
    dropped: int
    sums: dict


def poisson_two_way(d: Design, sets: tuple[str, str], tol: float, max_iter: int) -> TwoWayPoisson:
    """Newton steps on the slopes and the smaller set's effects; the larger set's effects have a closed form given these.

    Levels of either set whose outcome sums to zero carry no information on the slopes; they are left out and counted.
    """
    spark, x, p = d.data.sparkSession, d.xcols, len(d.xcols)
    large, small, levels = order_sets(d.data, sets)
    yc = F.col("__y")
    informative = d.data.groupBy(small).agg(F.sum(yc).alias("__Y")).filter("__Y > 0").select(small)
    levels = informative.withColumn(LEVEL, F.row_number().over(Window.orderBy(small)) - 1)
    n_levels, all_levels = levels.count(), d.data.select(small).distinct().count()
    data = d.data.join(F.broadcast(levels), small).select(large, small, LEVEL, "__one", *x, "__y", "__off")
    spread = spread_rows(data, large, d.n)
    n_pairs = len(triangle_pairs(p + 1))
    own = spread.rows.groupBy(LEVEL).agg(*[F.sum(yc * F.col(c)).alias(c) for c in ["__one", *x]]).collect()  # a row per level
    y_level = np.zeros(n_levels)
    for r in own:
        y_level[r[LEVEL]] = r["__one"]
    sxy = np.array([sum(r[c] for r in own) for c in x], float)

    def effect(values: np.ndarray) -> DataFrame:
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"{LEVEL} int, __beta double")

    def with_mean(b: np.ndarray, beta: np.ndarray) -> DataFrame:
        e = F.exp(linear_predictor(x, b) + F.col("__off") + F.col("__beta"))
        return spread.rows.join(F.broadcast(effect(beta)), LEVEL).withColumn("__e", e)

    def evaluate(b: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, System]:
        cells = moments(with_mean(b, beta), ["__one", *x], "__e", by=[large, LEVEL], extra=["__y"])
        total = F.col("m")[n_pairs]
        s = eliminate(cells, large, p + 1, n_levels, total / F.col("m")[0], (f"m[{n_pairs}] * ln(m[0])", "1D"))
        ll = float(sxy @ b + y_level @ beta - s.extra[0])
        return ll, sxy - s.column_sums, y_level - s.level_sums, s

    b, beta, kept = np.zeros(p), np.zeros(n_levels), None
    ll, grad, grad_level, s = evaluate(b, beta)
    for _ in range(max_iter):
        at = s.free()
        if kept is None:
            kept = drop_aliased(s.both_out(), floor=1e-9 * d.n)
        full = np.block([[s.columns[np.ix_(kept, kept)], s.mixed[np.ix_(at, kept)].T], [s.mixed[np.ix_(at, kept)], s.levels[np.ix_(at, at)]]])
        found = np.linalg.solve(full, np.concatenate([grad[kept], grad_level[at]]))
        step, step_level = np.zeros(p), np.zeros(n_levels)
        step[kept], step_level[at] = found[: len(kept)], found[len(kept) :]
        factor = 1.0
        for _ in range(30):  # halve until the likelihood does not fall
            new = evaluate(b + factor * step, beta + factor * step_level)
            if new[0] >= ll - 1e-9 * (1.0 + abs(ll)):
                break
            factor /= 2.0
        else:
            raise ArithmeticError("no step along the slope raises the likelihood")
        b, beta, (ll, grad, grad_level, s) = b + factor * step, beta + factor * step_level, new
        if factor * np.max(np.abs(found), initial=0.0) < tol * (1.0 + max(np.max(np.abs(b), initial=0.0), np.max(np.abs(beta), initial=0.0))):
            break
    else:
        raise ArithmeticError(f"no convergence in {max_iter} rounds")

    alpha, sums = poisson_groups(with_mean(b, beta), large, F.col("__e"))
    by_level = levels.join(F.broadcast(effect(beta)), LEVEL).select(small, "__beta")
    spread.release()
    bread = np.linalg.inv(s.both_out()[np.ix_(kept, kept)])
    return TwoWayPoisson(b[kept], kept, bread, [alpha, by_level], int(s.extra[1]) + len(s.free()), int(sums["n"]), int(sums["dropped"]) + all_levels - n_levels, {"x2": sums["x2"], "half_dev": sums["half_dev"]})

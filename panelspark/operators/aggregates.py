"""Tables, summaries, histograms and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import strict_avg, strict_sum
from ..session import handed_over
from .ranks import CELLS as _CELLS
from .ranks import average_ranks, exact_quantiles, range_splits
from .reshape import unpivot


def freq_table(df: DataFrame, col: str) -> DataFrame:
    """Count per value; missing values are not tabulated."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def six_number(df: DataFrame, col: str) -> DataFrame:
    """min, q1, median, mean, q3, max and the number of missing values, as one row."""
    base = df.agg(
        F.min(col).cast("double").alias("min"),
        F.avg(col).alias("mean"),
        F.max(col).cast("double").alias("max"),
        F.count_if(F.col(col).isNull()).alias("n_null"),
    )
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    return base.withColumns({c: q.select(c).scalar() for c in q.columns})


def group_profile(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Mean, sum and quartiles per group, null-propagating."""
    sums = df.groupBy(*by).agg(strict_avg(col).alias("mean"), strict_sum(col).alias("sum"))
    q = exact_quantiles(df, col, [0.25, 0.75], by=by, names=["q1", "q3"])
    complete = F.col("sum").isNotNull()
    return sums.join(q, list(by), "left").withColumns({c: F.when(complete, F.col(c)) for c in ("q1", "q3")})


def first_seen(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values with the order key of their first appearance."""
    return df.groupBy(col).agg(F.min(order).alias("first_seen"))


def mean_of_sums(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, name: str) -> DataFrame:
    """Null-propagating sum per `inner` group, then the null-skipping mean of those sums per `outer` group."""
    sums = df.groupBy(*inner).agg(strict_sum(value).alias("__s"))
    return sums.groupBy(*outer).agg(F.avg("__s").alias(name))


def _bin_no(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / F.lit(bins - 1)
    raw = F.ceil(F.try_divide(x - lo, width) + F.lit(0.5))
    # A constant column has no width: everything is in the first bin.
    return F.when(width > 0, F.greatest(F.least(raw, F.lit(bins)), F.lit(1))).otherwise(F.lit(1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, center, n): right-closed bins, the first centred on the minimum and the last on the maximum."""
    if bins < 2:
        raise ValueError("at least two bins")
    present = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    lo, hi = present.agg(F.min("x")).scalar(), present.agg(F.max("x")).scalar()
    counts = present.withColumn("bin", _bin_no(F.col("x"), lo, hi, bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (lo + (F.col("bin") - 1) * (hi - lo) / F.lit(bins - 1)).alias("center"), "n")


def histogram_all(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """`histogram` of every listed column over its own range, stacked with a `key` column."""
    long = unpivot(df, [], list(cols), "key", "x").filter(F.col("x").isNotNull())
    # One row per listed column.
    bounds = F.broadcast(long.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    binned = long.join(bounds, "key").withColumn("bin", _bin_no(F.col("x"), F.col("lo"), F.col("hi"), bins))
    counts = binned.groupBy("key", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    center = F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / F.lit(bins - 1)
    return counts.select("key", "bin", center.alias("center"), "n")


#: A value with at least one in so many rows is hot; a column has as many of them at most.
_HOT = 10_000


def _with_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per row of `df` with `__rank_<col>` for every column, ties at their mean rank. No column has missing values.

    The rows are handed over once with an id. All columns are then ranked as one long table keyed by column, and the ranks
    go back by id, so the number of scans and exchanges does not grow with the columns. Ranks of hot values are broadcast, so
    all numbers that meet in an exchange have keys of few rows; tasks get more in number with the rows, not larger.
    """
    rows = handed_over(df.select(*cols).withColumn("__id", F.monotonically_increasing_id()), "ranked-rows")
    long = rows.select("__id", F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("__at", "value"))
    n = rows.count()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * len(cols) // _CELLS))
    splits = sorted({x for cuts in range_splits(rows, cols, -(-8 * n // _CELLS)) for x in cuts})
    ranks = handed_over(average_ranks(long, "value", by=["__at"], splits=splits, tasks=tasks), "ranks")
    is_hot = F.col("cnt") * _HOT >= n
    # At most _HOT rows per listed column.
    hot = F.broadcast(ranks.filter(is_hot).select("__at", "value", "rank"))
    known = long.join(hot, ["__at", "value"]).select("__id", "__at", "rank")
    # Dealt by one whole number, and compared after that: as join keys, doubles would be dealt anew, by the session's number of tasks.
    key = F.xxhash64("__at", "value").alias("__key")
    rare = ranks.filter(~is_hot).select(key, F.col("__at").alias("__of"), F.col("value").alias("__as"), "rank").repartition(tasks, "__key")
    others = long.join(hot, ["__at", "value"], "left_anti").select("__id", "__at", "value", key).repartition(tasks, "__key")
    equal = F.col("__at").between(F.col("__of"), F.col("__of")) & F.col("value").between(F.col("__as"), F.col("__as"))
    looked = others.join(rare.hint("merge"), (others["__key"] == rare["__key"]) & equal).select("__id", "__at", "rank")
    # Dealt before they are brought together, so that no task has to hold all ids of what it reads.
    back = known.union(looked).repartition(tasks, "__id").groupBy("__id")
    return back.agg(*[F.max(F.when(F.col("__at") == i, F.col("rank"))).alias(f"__rank_{c}") for i, c in enumerate(cols)])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation over complete pairs, ties at their mean rank."""
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    ranked = _with_ranks(pairs, ["x", "y"])
    return ranked.agg(F.corr("__rank_x", "__rank_y").alias("rho"))


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", digits: int | None = None) -> DataFrame:
    """Long (var1, var2, i, j, value) correlation matrix over complete rows.

    All pairs come out of one aggregation; the result has len(cols)^2 rows.
    """
    cols = list(cols)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    if method == "spearman":
        data = _with_ranks(data, cols)
        at = {c: f"__rank_{c}" for c in cols}
    elif method == "pearson":
        at = {c: c for c in cols}
    else:
        raise ValueError(f"unknown method {method!r}")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = data.agg(*[F.corr(at[cols[i]], at[cols[j]]).alias(f"c{i}_{j}") for i, j in pairs])
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = F.col(f"c{min(i, j)}_{max(i, j)}")
            v = v if digits is None else F.round(v, digits)
            cells.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("value")))
    return row.select(F.inline(F.array(*cells)))


def corr_of_matrix(matrix: DataFrame) -> DataFrame:
    """Pearson correlation between the columns of a long matrix; work is on its p^2 cells."""
    a = matrix.select(F.col("var1").alias("row"), F.col("var2").alias("v1"), F.col("value").alias("a"))
    b = matrix.select(F.col("var1").alias("row"), F.col("var2").alias("v2"), F.col("value").alias("b"))
    return a.join(b, "row").groupBy(F.col("v1").alias("var1"), F.col("v2").alias("var2")).agg(F.corr("a", "b").alias("value"))


def triangle(matrix: DataFrame, upper: bool = True) -> DataFrame:
    """Cells on and above (or below) the diagonal, nulls dropped."""
    side = F.col("i") <= F.col("j") if upper else F.col("i") >= F.col("j")
    return matrix.filter(side & F.col("value").isNotNull())


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Intercept and slope of y on x over complete pairs."""
    return df.agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def period_apply(
    df: DataFrame, ids: Sequence[str], date: str, unit: str, aggs: Mapping[str, Column]
) -> DataFrame:
    """Aggregate each column over calendar periods, per id or pooled.

    `aggs` maps output name -> aggregate column. The result carries the period's first day as
    `period` and its last observed day as `date_last`, the label a time-series roll-up would use.
    """
    day = F.col(date).cast("date")
    return (
        df.withColumn("__period", F.trunc(day, unit) if unit != "day" else day)
        .groupBy(*ids, F.col("__period").alias("period"))
        .agg(F.max(day).alias("date_last"), *[c.alias(name) for name, c in aggs.items()])
    )


def stack_offsets(df: DataFrame, at: str, layer: str, value: str) -> DataFrame:
    """Lower and upper edge of each layer of a stacked area; one row per layer and position."""
    w = Window.partitionBy(at).orderBy(layer).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("ymax", F.sum(value).over(w)).withColumn("ymin", F.col("ymax") - F.col(value))

"""Derived columns of the area-by-period and person-by-period panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import as_col, indicator


def rescale(df: DataFrame, cols: Sequence[str], k: float) -> DataFrame:
    """Divide each of `cols` by `k` in place; `k=-1` negates."""
    return df.withColumns({c: F.col(c) / F.lit(float(k)) for c in cols})


def row_total(df: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
    """Sum across columns; null when any part is null."""
    return df.withColumn(name, reduce(add, [F.col(c) for c in cols]))


def interaction(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    return df.withColumn(name, F.col(a) * F.col(b))


def step_events(df: DataFrame, time: str, cutoffs: Mapping[str, int]) -> DataFrame:
    """One post-event step per entry: 1 once `time` passes the cutoff."""
    return df.withColumns({name: indicator(F.col(time) > k) for name, k in cutoffs.items()})


def value_dummies(df: DataFrame, col: str, values: Sequence, prefix: str) -> DataFrame:
    """Full set of 0/1 columns, one per listed value."""
    return df.withColumns({f"{prefix}{v}": indicator(F.col(col) == F.lit(v)) for v in values})


def treatment_dummies(df: DataFrame, col: str, levels: Sequence, base, prefix: str | None = None) -> DataFrame:
    """0/1 columns for every level but `base`."""
    prefix = f"{col}_" if prefix is None else prefix
    return value_dummies(df, col, [v for v in levels if v != base], prefix)


def cut_points(col: Column | str, breaks: Sequence[float], codes: Sequence[int] | None = None) -> Column:
    """Bucket by ascending `breaks`: code i where breaks[i-1] <= x < breaks[i]; null stays null."""
    c = as_col(col)
    codes = list(range(len(breaks) + 1)) if codes is None else list(codes)
    if len(codes) != len(breaks) + 1 or list(breaks) != sorted(breaks):
        raise ValueError("breaks must ascend and codes must be one longer")
    out = F.when(c < breaks[0], F.lit(codes[0]))
    for i in range(1, len(breaks)):
        out = out.when(c < breaks[i], F.lit(codes[i]))
    return out.when(c >= breaks[-1], F.lit(codes[-1]))


def period_index(year: Column | str, period: Column | str, origin: tuple[int, int], per_year: int, last: int) -> Column:
    """1-based running period number from `origin`; null outside 1..last."""
    y0, p0 = origin
    n = (as_col(year) - y0) * per_year + (as_col(period) - p0) + 1
    n = n.cast("int")
    return F.when(n.between(1, last), n)


def relabel(df: DataFrame, col: str, levels: Sequence[str], labels: Sequence[str], into: str | None = None) -> DataFrame:
    """Map `levels` to `labels` and keep the level's position as `<into>_ord`; unlisted values become null."""
    into = into or f"{col}_f"
    pairs = list(zip(levels, labels, strict=True))
    label = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    ordinal = F.create_map(*[F.lit(v) for i, lv in enumerate(levels, 1) for v in (lv, i)])
    return df.withColumns({into: F.try_element_at(label, F.col(col)), f"{into}_ord": F.try_element_at(ordinal, F.col(col))})


def lookup(col: Column | str, table: Mapping) -> Column:
    """Named-vector lookup; null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), as_col(col))


def share_of_total(df: DataFrame, col: str, name: str) -> DataFrame:
    """Each row's share of the column total, the total being a one-row scalar subquery."""
    total = df.agg(F.sum(col)).scalar()
    return df.withColumn(name, F.col(col) / total)


def relative_change(x: Column | str, base: Column | str) -> Column:
    """(x - base) / base, null where the base is zero or missing."""
    x, base = as_col(x), as_col(base)
    return F.try_divide(x - base, base)


def absolute_change(x: Column | str, base: Column | str) -> Column:
    return as_col(x) - as_col(base)

"""Aggregates and predicates that keep missing values missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _complete(c: Column, agg: Column) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(c), agg)


def strict_sum(c: Column | str) -> Column:
    """Sum that is null as soon as one input is null."""
    c = as_col(c)
    return _complete(c, F.sum(c))


def strict_avg(c: Column | str) -> Column:
    """Mean that is null as soon as one input is null."""
    c = as_col(c)
    return _complete(c, F.avg(c))


def strict_sum_where(flag: Column, c: Column | str) -> Column:
    """`strict_sum` over the rows where `flag` holds; null when there are none."""
    c = as_col(c)
    inside = F.when(flag, c)
    return F.when(F.count(F.when(flag, 1)) == F.count(inside), F.sum(inside))


def n_distinct_with_null(c: Column | str) -> Column:
    """Distinct count in which a missing value counts as one more value."""
    c = as_col(c)
    return F.countDistinct(c) + F.max(c.isNull().cast("int"))


def indicator(condition: Column) -> Column:
    """0/1 flag that stays null where the condition is unknown."""
    return condition.cast("int")

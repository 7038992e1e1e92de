"""Ordered operators over panels.

The windows here partition by id and expect one row per (id, time), so a partition holds at most
one row per calendar period. Whole-history questions over raw rows (first day, last day) are
aggregates instead, which combine before the shuffle and do not care about a hot id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import global_row_number


def _by(ids: Sequence[str] | str, time: str):
    ids = [ids] if isinstance(ids, str) else list(ids)
    return Window.partitionBy(*ids).orderBy(F.col(time).asc_nulls_last())


def group_sequence(df: DataFrame, ids: Sequence[str] | str, time: str, name: str = "time") -> DataFrame:
    """1, 2, ... within each id in `time` order."""
    return df.withColumn(name, F.row_number().over(_by(ids, time)))


def running_total(df: DataFrame, ids: Sequence[str] | str, time: str, col: str, name: str) -> DataFrame:
    w = _by(ids, time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(col).over(w))


def lag_by(df: DataFrame, ids: Sequence[str] | str, time: str, col: str, name: str, across: bool = False) -> DataFrame:
    """Previous row's value of `col` within the id.

    `across=True` is the positional lag of an ungrouped vector in (id, time) order: the first row of
    an id takes the last value of the id before it. It is done by a distributed numbering, not by
    one global window.
    """
    if not across:
        return df.withColumn(name, F.lag(col).over(_by(ids, time)))
    ids = [ids] if isinstance(ids, str) else list(ids)
    numbered = global_row_number(df, [*ids, time], "__rn")
    previous = numbered.select((F.col("__rn") + 1).alias("__rn"), F.col(col).alias(name))
    return numbered.join(previous, "__rn", "left").drop("__rn")


def entry_exit(df: DataFrame, ids: Sequence[str] | str, date: str, nulls_last: bool = False) -> DataFrame:
    """First and last date per id.

    `nulls_last=True` reads "last" as the last row of an ascending sort with missing dates at the
    end, so an id with a missing date gets a null exit.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    exit_ = F.max(date)
    if nulls_last:
        exit_ = F.when(F.count(F.lit(1)) == F.count(date), exit_)
    return df.groupBy(*ids).agg(F.min(date).alias("entry"), exit_.alias("exit"))


def first_last_row(
    df: DataFrame, ids: Sequence[str] | str, order: str, last: bool = False, ties: Sequence[str] = ()
) -> DataFrame:
    """The whole first (or last) row per id, missing order values last; an aggregate, not a sort.

    `ties` names columns that decide between rows of one id and order value; without them any of these may be picked.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    rest = [c for c in df.columns if c not in ids]
    rank = F.struct(F.col(order).isNull(), F.col(order), *(F.col(c).alias(f"__t{i}") for i, c in enumerate(ties)))
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), rank)
    return df.groupBy(*ids).agg(pick.alias("__row")).select(*ids, "__row.*")


def follow_up(df: DataFrame, ids: Sequence[str] | str, date: str) -> DataFrame:
    """Attach entry, exit, entry year and days of follow-up to every row."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    spans = entry_exit(df, ids, date).withColumns(
        {"entry_yr": F.year("entry"), "duration": F.date_diff("exit", "entry")}
    )
    return df.join(spans, ids, "left")


def row_slice(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Rows `first`..`last` of a small table by an explicit order key.

    The top `last` rows are found per task and merged, so no full sort takes place.
    """
    head = df.orderBy(F.col(order).asc_nulls_last()).limit(last)
    w = Window.orderBy(F.col(order).asc_nulls_last())
    return head.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") >= first).drop("__rn")

"""Joins with the key rules panels need.

No side is broadcast by hand: the planner broadcasts only what its size estimate
(`spark.sql.autoBroadcastJoinThreshold`) allows and splits skewed keys otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Left equi-join; a mapping gives left name -> right name, and the left names stay."""
    if isinstance(keys, Mapping):
        right = right.withColumnsRenamed({r: l for l, r in keys.items()})
        keys = list(keys)
    return left.join(right, on=list(keys), how="left")


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    names = [c for c in left.columns if c in set(right.columns)]
    if not names:
        raise ValueError("the tables share no column name")
    return names


def natural_left_join(left: DataFrame, right: DataFrame, nulls_match: bool = False) -> DataFrame:
    """Left join on every shared name; `nulls_match` lets a missing key meet a missing key."""
    names = shared_columns(left, right)
    if not nulls_match:
        return left.join(right, on=names, how="left")
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in names})
    matched = reduce(and_, [left[c].eqNullSafe(other[f"__r_{c}"]) for c in names])
    return left.join(other, matched, "left").drop(*[f"__r_{c}" for c in names])


def suffix_left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Left join that renames equal non-key names on both sides instead of leaving them ambiguous."""
    clash = [c for c in left.columns if c in set(right.columns) and c not in set(on)]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return a.join(b, on=list(on), how="left")


def restrict_to_cohort(ids: DataFrame, events: DataFrame, id_col: str, event_id: str, keep_unmatched: bool = True) -> DataFrame:
    """Events of the cohort; cohort members without events stay as null rows unless told otherwise."""
    if keep_unmatched:
        return left_join(ids, events, {id_col: event_id})
    return events.join(ids.select(F.col(id_col).alias(event_id)), event_id, "left_semi")


def factorised_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_cols: Sequence[str] = (), right_cols: Sequence[str] = (),
    weight: str = "n", split: int = 1,
) -> DataFrame:
    """Inner many-to-many join as (on, left_cols, right_cols, weight): how many pairs of rows each combination stands for.

    Both sides are counted down to their distinct combinations first, so rows that the result does not tell apart are never
    paired. `split` deals the left combinations of every key over so many tasks, for keys that have very many of them. Rows
    with a missing key meet nothing.
    """
    a = left.groupBy(*on, *left_cols).agg(F.count(F.lit(1)).alias("__left"))
    b = right.groupBy(*on, *right_cols).agg(F.count(F.lit(1)).alias("__right"))
    keys = list(on)
    if split > 1:
        a = a.withColumn("__part", F.pmod(F.xxhash64(*a.columns), F.lit(split)).cast("int"))
        b = b.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
        keys.append("__part")
    return a.join(b, keys).select(*on, *left_cols, *right_cols, (F.col("__left") * F.col("__right")).alias(weight))


def opened_pairs(joined: DataFrame, weight: str = "n") -> DataFrame:
    """A row for every pair that `factorised_join` counted."""
    return joined.withColumn("__pair", F.explode(F.sequence(F.lit(1).cast("long"), F.col(weight)))).drop("__pair", weight)

"""Pre/post contrasts and exposure groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import strict_sum_where


def pre_post_sums(df: DataFrame, ids: Sequence[str], pre: Column, post: Column, measures: Mapping[str, str]) -> DataFrame:
    """`<name>_pre` and `<name>_post` null-propagating sums per id."""
    aggs = []
    for name, col in measures.items():
        aggs += [strict_sum_where(pre, col).alias(f"{name}_pre"), strict_sum_where(post, col).alias(f"{name}_post")]
    return df.groupBy(*ids).agg(*aggs)


def pre_post_diff(df: DataFrame, ids: Sequence[str], pre: Column, post: Column, measures: Mapping[str, str]) -> DataFrame:
    """Post minus pre for every measure, all in one aggregation over `ids`.

    Replaces a group-sum, spread and subtract per measure followed by joins of the pieces.
    """
    aggs = [
        (strict_sum_where(post, col) - strict_sum_where(pre, col)).alias(name) for name, col in measures.items()
    ]
    return df.groupBy(*ids).agg(*aggs)


def exposed_groups(df: DataFrame, ids: Sequence[str], pre: Column, exposure: str, threshold: float | None = None) -> DataFrame:
    """(ids, pre_exposure, exposed): 1 when the pre-period sum reaches the threshold.

    Without a threshold the mean of the pre-period sums is used.
    """
    sums = df.groupBy(*ids).agg(strict_sum_where(pre, exposure).alias("pre_exposure"))
    limit = sums.agg(F.avg("pre_exposure")).scalar() if threshold is None else F.lit(float(threshold))
    return sums.withColumn("exposed", (F.col("pre_exposure") >= limit).cast("int"))

"""Cohorts defined by when a person was observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import n_distinct_with_null


def k_distinct_cohort(df: DataFrame, id_col: str, category: str, k: int) -> DataFrame:
    """Ids seen in exactly `k` distinct categories (a missing category counts as one)."""
    counts = df.groupBy(id_col).agg(n_distinct_with_null(category).alias("n_unique"))
    return counts.filter(F.col("n_unique") == k).select(id_col)


def observed_in_all(df: DataFrame, id_col: str, category: str, periods: Sequence) -> DataFrame:
    """Ids with at least one row in every listed period, whatever else they have."""
    seen = [F.max((F.col(category) == F.lit(p)).cast("int")).alias(f"__p{i}") for i, p in enumerate(periods)]
    flags = df.groupBy(id_col).agg(*seen)
    for i in range(len(periods)):
        flags = flags.filter(F.col(f"__p{i}") == 1)
    return flags.select(id_col)

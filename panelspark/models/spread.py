"""Rows kept together by group for repeated per-group sums, hot groups cut into parts.

Rows are shuffled once and stay in place: per-group sums of ordinary groups then need no shuffle in
any round. A group larger than half an even share of a partition is cut into as many parts as there
are partitions and its parts are added up afterwards; there are at most twice as many such groups as
partitions, so their number on the driver is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import moments, sum_vectors

PART = "__part"
ROWS_PER_PART = 200_000
SMALL_GROUP = 1000  # never worth cutting


@dataclass
class Spread:
    rows: DataFrame
    key: str
    hot: list
    parts: int

    @property
    def keys(self) -> list[str]:
        """Columns the rows are partitioned by."""
        return [self.key, PART] if self.hot else [self.key]

    def select(self, *cols) -> Spread:
        return Spread(self.rows.select(*self.keys, *cols), self.key, self.hot, self.parts)

    def join_groups(self, groups: DataFrame) -> Spread:
        """Inner join with one row per group; a hot group's row is copied to each of its parts."""
        if self.hot:
            last = F.when(F.col(self.key).isin(self.hot), F.lit(self.parts - 1)).otherwise(F.lit(0))
            groups = groups.withColumn(PART, F.explode(F.sequence(F.lit(0), last)))
        return Spread(self.rows.join(groups, self.keys), self.key, self.hot, self.parts)

    def group_moments(self, cols: Sequence[str], weight: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
        """(key, m) with one row per group."""
        if not self.hot:
            return moments(self.rows, cols, weight, self.keys, extra)
        is_hot = F.coalesce(F.col(self.key).isin(self.hot), F.lit(False))
        cold = moments(self.rows.filter(~is_hot), cols, weight, self.keys, extra).drop(PART)
        pieces = moments(self.rows.filter(is_hot), cols, weight, self.keys, extra)
        return cold.unionByName(sum_vectors(pieces, "m", [self.key]))

    def release(self) -> None:
        self.rows.unpersist()


def spread_rows(df: DataFrame, key: str, n: int, share: float = 0.5) -> Spread:
    """Partition the `n` rows of `df` by `key`, in as many parts as they fill."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2, min(most, spark.sparkContext.defaultParallelism), -(-n // ROWS_PER_PART))
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = [r[0] for r in sizes.filter(F.col("n") > max(share * n / parts, SMALL_GROUP)).select(key).collect()]
    if hot:
        # by place, as the rows of a group may all be alike
        place = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
        part = F.when(F.col(key).isin(hot), place).otherwise(F.lit(0))
        rows = df.withColumn(PART, part).repartition(parts, key, PART)
    else:
        rows = df.repartition(parts, key)
    return Spread(rows.persist(), key, hot, parts)

"""Exact order statistics without a single-task sort.

Values are cut into ranges at approximate quantiles. A value at a cut, as every hot one is, is counted
on the map side; the values between two cuts are few, so they are dealt by range, then counted and
numbered there; range totals give the offsets. There are more ranges and tasks for more rows, not larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


#: Numbers that a task gets when values are counted; ranges hold about an eighth, so that few of them make a task uneven.
CELLS = 1_000_000
#: Ranges asked for in a column at most; they grow from 1.25 billion values on, and tasks from 10 billion.
_RANGES = 10_000


def range_splits(df: DataFrame, cols: Sequence[str], ranges: int = 0) -> list[list[float]]:
    """Ascending cut points for about equally filled ranges of each column, in one pass.

    They only balance the work; results do not depend on them. There are `ranges` of them, or
    as many as the session has tasks, as far as values differ.
    """
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(ranges, _RANGES))
    probs = [i / n for i in range(1, n)]
    cuts = df.approxQuantile(list(cols), probs, 1.0 / (4 * n))
    return [sorted({float("-inf"), *(x + 0.0 for x in c), float("inf")}) for c in cuts]


def value_positions(
    df: DataFrame, col: str, by: Sequence[str] = (), splits: list[float] | None = None, tasks: int | None = None
) -> DataFrame:
    """(by, value, cnt, before, n): `before` counts the group's smaller values, `n` all its values.

    Nulls are left out, as values and as groups. Values between cuts are dealt to `tasks` tasks, if the session has fewer.
    """
    by = list(by)
    # Negative zero becomes zero.
    d = df.select(*by, (F.col(col).cast("double") + F.lit(0.0)).alias("value"))
    for c in d.columns:
        d = d.filter(F.col(c).isNotNull())
    if tasks is None:
        tasks = -(-d.count() // CELLS)
    splits = splits or range_splits(d, ["value"], 8 * tasks)[0]
    if len(splits) > 2:
        d = Bucketizer(splits=splits, inputCol="value", outputCol="__bucket").transform(d)
    else:
        d = d.withColumn("__bucket", F.lit(0.0))
    bucket = F.col("__bucket").cast("int")
    # Even numbers are the cuts themselves, odd ones the ranges between them.
    place = F.when(F.col("value") == F.element_at(F.lit(splits), bucket + 1), 0).when(F.col("value") == F.lit(splits[-1]), 2).otherwise(1)
    d = d.withColumn("__range", 2 * bucket + place).drop("__bucket")
    keys = [*by, "__range"]
    at_cut = F.col("__range") % 2 == 0
    few = tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    between = d.filter(~at_cut).repartition(*([] if few else [tasks]), *keys)
    counts = between.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))
    inside = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and range or cut: at most twice len(splits) rows per group meet in one window.
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = d.filter(at_cut).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max("value").alias("__cut"))
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("__n")).withColumn("__cut", F.lit(None).cast("double")).unionByName(cuts)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    offsets = totals.select(*keys, "__cut", "__n", before.alias("__off"), F.sum("__n").over(Window.partitionBy(*by)).alias("n"))
    # A cut meets no counted values: it is its own.
    placed = counts.withColumn("__in", F.sum("cnt").over(inside)).join(offsets, keys, "right")
    return placed.select(
        *by, F.coalesce("value", "__cut").alias("value"), F.coalesce("cnt", "__n").alias("cnt"),
        (F.coalesce("__in", F.lit(0)) + F.col("__off")).alias("before"), "n",
    )


def average_ranks(
    df: DataFrame, col: str, by: Sequence[str] = (), splits: list[float] | None = None, tasks: int | None = None
) -> DataFrame:
    """(by, value, cnt, rank) with tied values sharing their mean rank."""
    pos = value_positions(df, col, by, splits, tasks)
    return pos.withColumn("rank", F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)).drop("before", "n")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolation quantiles (position (n-1)p) per group, one column per probability."""
    by = list(by)
    names = list(names or [f"q{round(100 * p)}" for p in probs])
    pos = value_positions(df, col, by)
    aggs: list[Column] = []
    for i, p in enumerate(probs):
        for tag, cut in (("lo", "floor"), ("hi", "ceil")):
            k = f"{cut}((n - 1) * {float(p)!r}D)"
            aggs.append(F.expr(f"max(CASE WHEN before <= {k} AND {k} < before + cnt THEN value END)").alias(f"__{tag}{i}"))
    picked = pos.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    out = []
    for i, (p, name) in enumerate(zip(probs, names, strict=True)):
        h = f"(n - 1) * {float(p)!r}D"
        out.append(F.expr(f"__lo{i} + ({h} - floor({h})) * (__hi{i} - __lo{i})").alias(name))
    return picked.select(*by, *out)


def global_row_number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1..n in `order` over the whole table, by range-partitioned sort and partition offsets.

    The order must be total (add a key): it also splits a hot value over several ranges. The sorted
    rows are checkpointed so that numbers and offsets come from the same run of the range sampling.
    """
    row_bits = 33
    ordered = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    ordered = checkpointed(ordered)
    part = F.shiftright(F.col("__id"), row_bits)
    ordered = ordered.withColumns({"__part": part, "__row": F.col("__id") - F.shiftleft(part, row_bits)})
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row per sort partition: bounded by the number of shuffle partitions.
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    out = ordered.join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__row") + F.col("__off") + 1).drop("__id", "__part", "__row", "__off")


def null_safe_ntile(df: DataFrame, col: str, n: int, key: Sequence[str], name: str) -> DataFrame:
    """Tile 1..n by `col` (ties in `key` order); null for null, and nulls do not shift the tiles.

    As in SQL, the first (count mod n) tiles hold one row more.
    """
    present = global_row_number(df.filter(F.col(col).isNotNull()), [col, *key], "__rn")
    total = present.agg(F.count(F.lit(1)).alias("__n")).scalar()
    small = F.floor(total / F.lit(n))
    big = total % n
    in_big = big * (small + 1)
    rn = F.col("__rn") - 1
    tile = F.when(rn < in_big, F.floor(rn / (small + 1))).otherwise(big + F.floor(F.try_divide(rn - in_big, small)))
    tiled = present.withColumn(name, (tile + 1).cast("int")).drop("__rn")
    missing = df.filter(F.col(col).isNull()).withColumn(name, F.lit(None).cast("int"))
    return tiled.unionByName(missing)

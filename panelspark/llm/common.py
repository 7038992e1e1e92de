"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelspark.session import checkpointed, scratch_path  # noqa: F401  (re-exported)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `(spark, folder) -> DataFrame` under `name`, with its SQL statement if there is one."""

    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            ORACLE[name] = sql
        return plan

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read again: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`written`, and how many rows there were, counted while writing."""
    seen = Observation()
    return written(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key() -> F.Column:
    """64-bit fingerprint of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fenced(df: DataFrame) -> DataFrame:
    """`df` as it is, with a fence for the optimizer: a filter above stays above.

    Pushed below, a condition on a column would take that column's whole expression along, once for each mention at
    every step of a long chain of array functions; the plan then grows beyond any use.
    """
    return df.withColumn("_fence", F.monotonically_increasing_id()).filter("_fence >= 0").drop("_fence")


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`operator(docs, ...)`, whose own working columns begin with an underscore, for docs that have such columns too: they
    are called something else meanwhile and come back as they were."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        hidden = {c: f"input {i}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        if not hidden:
            return operator(docs, *args, **kwargs)
        out = operator(docs.withColumnsRenamed(hidden), *args, **kwargs)
        return out.withColumnsRenamed({new: old for old, new in hidden.items()})

    return run

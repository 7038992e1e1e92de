"""Registry of the queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan `Tables -> DataFrame` under `name`, with its SQL statement if there is one."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return plan

    return register


def settled(c: Column | str, digits: int) -> Column:
    """Round after a nudge far below the last digit kept.

    Means of two-decimal amounts often end in a 5 just past the kept digits, where the order of
    summation would decide the rounding; `settled_sql` states the same value.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(float(f"3e-{digits + 3}")), digits)


def settled_sql(expr: str, digits: int) -> str:
    return f"round({expr} + 3e-{digits + 3}, {digits})"

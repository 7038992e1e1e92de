"""Wide and long forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_value(at: Column, value: str, what: str, kind: str) -> Column:
    """The single value at this cell; fails the job when the key is not unique."""
    clash = F.raise_error(F.lit(f"duplicate keys while spreading {what}")).cast(kind)
    return F.when(F.count(F.when(at, 1)) > 1, clash).otherwise(F.max(F.when(at, F.col(value))))


def pivot_units(
    df: DataFrame, keys: Sequence[str], unit: str, value: str, levels: Sequence, names: Sequence[str] | None = None
) -> DataFrame:
    """One column per unit level. Stated levels save the discovery job; duplicates are an error.

    One pass of conditional aggregates with map-side combine.
    """
    names = list(names or levels)
    kind = df.schema[value].dataType.simpleString()
    cells = [_one_value(F.col(unit) == F.lit(lv), value, unit, kind).alias(str(nm)) for lv, nm in zip(levels, names, strict=True)]
    return df.groupBy(*keys).agg(*cells)


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], key: str = "variable", value: str = "value") -> DataFrame:
    """Columns of one type keep it; numbers of different types become doubles."""
    kinds = {df.schema[c].dataType.simpleString() for c in cols}
    wide = df if len(kinds) == 1 else df.withColumns({c: F.col(c).cast("double") for c in cols})
    return wide.unpivot(list(ids), list(cols), key, value)

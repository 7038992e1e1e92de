"""Unit ids, codes and labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import lookup
from .nulls import as_col

# Plant codes and the names shown for them.
PLANT_NAMES = {
    "all": "All",
    "1363": "Cane Run",
    "1364": "Mill Creek",
    "983": "Clifty Creek",
    "6166": "Rockport",
}


def _selection(uid: Column) -> Column:
    """An alternation of several units has no plant or unit of its own."""
    return uid.contains("|")


def plant_code(uid: Column | str) -> Column:
    """Part before the first dash; empty for an alternation of several units."""
    u = as_col(uid)
    return F.when(~_selection(u), F.substring_index(u, "-", 1)).otherwise("")


def unit_code(uid: Column | str) -> Column:
    """Part after the last dash; empty for an alternation of several units."""
    u = as_col(uid)
    return F.when(~_selection(u), F.substring_index(u, "-", -1)).otherwise("")


def unit_title(uid: Column | str, names: Mapping[str, str] = PLANT_NAMES) -> Column:
    """"<plant> Unit <unit>" with the plant's name, or a generic title for plants without one and for selections."""
    plant = lookup(plant_code(uid), dict(names))
    return F.coalesce(F.concat(plant, F.lit(" Unit "), unit_code(uid)), F.lit("Select units'"))


def pad_code(c: Column | str, width: int = 5) -> Column:
    """Area code as text with leading zeros."""
    return F.lpad(as_col(c).cast("string"), width, "0")


def key(*cols: Column | str, sep: str = ".") -> Column:
    return F.concat_ws(sep, *[as_col(c) for c in cols])


def percent_text(x: Column, step: int = 2) -> Column:
    """Percent rounded half-to-even to a multiple of `step`."""
    n = F.bround(x * 100 / step, 0).cast("long") * step
    return F.concat(n.cast("string"), F.lit("%"))


def reduction_label(mean_change: Column | str) -> Column:
    """Map label; the sign is shown flipped, as a reduction."""
    m = as_col(mean_change)
    text = F.when(m > 0, F.concat(F.lit("-"), percent_text(m))).otherwise(percent_text(F.abs(m)))
    return F.concat(F.lit("mean reduction = "), text)

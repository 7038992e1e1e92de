"""Area codes, crosswalks, polygon area and change-from-base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import absolute_change, relative_change
from ..functions.dates import base_periods
from ..functions.nulls import as_col, strict_avg
from ..functions.text import pad_code, reduction_label

EARTH_RADIUS_M = 6371010.0


def filter_units(df: DataFrame, unit: str, pattern: str) -> DataFrame:
    """Rows whose unit id matches the pattern; 'all' keeps every row."""
    return df if pattern == "all" else df.filter(F.col(unit).rlike(pattern))


def crosswalk(areas: DataFrame, cw: DataFrame, on: str = "ZCTA", code: str = "ZIP", width: int = 5) -> DataFrame:
    """Many-to-many inner join of boundaries with a code crosswalk, target code zero-padded."""
    return areas.join(cw.withColumn(code, pad_code(code, width)), on, "inner")


def attach_boundaries(panel: DataFrame, areas: DataFrame, code: str, how: str = "inner") -> DataFrame:
    """Join a panel to boundary attributes by text code; keep geometry out of the shuffled side."""
    return panel.join(areas, code, how)


def _edge_excess(p: Column, q: Column) -> Column:
    """Signed spherical area between one great-circle edge and the equator, on the unit sphere."""
    half_dx = F.radians(q["x"] - p["x"]) / 2
    a, b = F.tan(F.radians(p["y"]) / 2), F.tan(F.radians(q["y"]) / 2)
    return F.lit(2.0) * F.atan(F.tan(half_dx) * (a + b) / (F.lit(1.0) + a * b))


def _signed_area(ring: Column) -> Column:
    """Area on the unit sphere, its sign the ring's orientation; a ring of under four points has none."""
    edges = F.sequence(F.lit(1), F.size(ring) - 1)
    total = F.aggregate(edges, F.lit(0.0), lambda s, i: s + _edge_excess(F.element_at(ring, i), F.element_at(ring, i + 1)))
    return F.when(F.size(ring) >= 4, total).otherwise(F.lit(0.0))


def ring_area(ring: Column | str) -> Column:
    """Area in square metres inside one closed ring of lon/lat degrees (first point repeated last)."""
    return F.abs(_signed_area(as_col(ring))) * F.lit(EARTH_RADIUS_M**2)


def _inside(point: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of degrees: an odd number of edges east of it."""

    def crosses(i: Column) -> Column:
        p, q = F.element_at(ring, i), F.element_at(ring, i + 1)
        east = (q["x"] - p["x"]) * F.try_divide(point["y"] - p["y"], q["y"] - p["y"]) + p["x"]
        return ((p["y"] > point["y"]) != (q["y"] > point["y"])) & (point["x"] < east)

    return F.size(F.filter(F.sequence(F.lit(1), F.size(ring) - 1), crosses)) % 2 == 1


def polygon_area(rings: Column | str) -> Column:
    """Area in square metres of a polygon of any number of parts, each with any holes, rings in any order.

    Holes run the other way round than parts, whichever way that is, so the rings' signed areas add up to the area. Where
    all rings run the same way, a ring is a hole if an odd number of the others surround its first point.
    """
    rs = as_col(rings)
    signed = F.transform(rs, _signed_area)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def nested(ring: Column, i: Column) -> Column:
        around = F.filter(rs, lambda other, j: (i != j) & (F.size(other) >= 4) & _inside(F.element_at(ring, 1), other))
        area = F.abs(_signed_area(ring))
        return F.when((area == 0) | (F.size(around) % 2 == 0), area).otherwise(-area)

    both = F.exists(signed, lambda a: a > 0) & F.exists(signed, lambda a: a < 0)
    area = F.when(both | (F.size(rs) < 2), F.abs(total(signed))).otherwise(total(F.transform(rs, nested)))
    return area * F.lit(EARTH_RADIUS_M**2)


def change_from_base(
    df: DataFrame,
    areas: DataFrame,
    unit_pattern: str = "all",
    period: str = "month",
    base_year: int = 2014,
    start: int | None = None,
    change: str = "pct",
    code: str = "ZIP",
    year: str = "year",
    unit: str = "uID",
    value: str = "exposure",
) -> DataFrame:
    """Change of mean exposure per area against the same period of the base window.

    Rows are those of the plot window, one year after the base window. Base and plot values of an
    area and period meet in one window partition, which holds one row per year at most.
    """
    n = {"month": 12, "quarter": 4}[period]
    base, plot = base_periods(base_year, start, n)
    use = filter_units(df, unit, unit_pattern)
    # Only the two windows are read: the predicate reaches the scan before any shuffle.
    use = use.filter(base.contains(year, period) | plot.contains(year, period))
    means = use.groupBy(code, F.col(period).alias("period"), year).agg(strict_avg(value).alias("mean_x"))
    known = means.join(areas.select(code), code, "inner")
    same = Window.partitionBy(code, "period")
    in_base = base.contains(year, "period")
    known = known.withColumn("mean_y", F.max(F.when(in_base, F.col("mean_x"))).over(same))
    pct = relative_change("mean_x", "mean_y")
    known = known.withColumns({"frac": pct, "change": pct if change == "pct" else absolute_change("mean_x", "mean_y")})
    return known.filter(plot.contains(year, "period"))


def mean_change_labels(changes: DataFrame, year: str = "year") -> DataFrame:
    """Mean fractional change per plotted period with its map label."""
    means = changes.groupBy("period", year).agg(strict_avg("frac").alias("mean_p"))
    return means.withColumn("label", reduction_label("mean_p"))

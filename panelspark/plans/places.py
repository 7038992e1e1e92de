"""N: crosswalks, polygon areas and change-from-base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import pad_code
from ..operators.joins import factorised_join
from ..operators.spatial import attach_boundaries, change_from_base, mean_change_labels, polygon_area
from .calendar import LABEL_SQL
from .frames import Tables, sql_on
from .registry import query, settled, settled_sql


def _areas(t: Tables):
    return t.nation.select(pad_code("n_nationkey").alias("ZIP"), "n_name")


@query(
    "n1_attach_boundaries",
    sql_on("counts", body="""SELECT zip AS ZIP, yrq, asthma_count, n_name FROM counts JOIN nation ON zip = lpad(CAST(n_nationkey AS VARCHAR), 5, '0')"""),
)
def attached(t: Tables):
    return attach_boundaries(t.counts().withColumnRenamed("zip", "ZIP"), _areas(t), "ZIP")


@query(
    "n2_crosswalk",
    """SELECT r_name AS ZCTA, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS ZIP, count(*) AS n
       FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def crosswalked(t: Tables):
    # Customers of a region meet the nations of that region: many rows on both sides of the code.
    cw = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("ZCTA"), F.col("n_nationkey").alias("ZIP")
    )
    areas = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("r_name").alias("ZCTA"), pad_code("c_nationkey").alias("own"))
    # Customers are counted by code before they meet the codes of their region; no customer is paired with a code.
    pairs = factorised_join(areas, cw.withColumn("ZIP", pad_code("ZIP")), ["ZCTA"], ["own"], ["ZIP"], split=4)
    return pairs.filter(F.col("own") == F.col("ZIP")).groupBy("ZCTA", "ZIP").agg(F.sum("n").alias("n"))


@query(
    "d6_many_to_many_join",
    """SELECT a.c_nationkey, count(*) AS pairs FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) a
       JOIN (SELECT s_nationkey, s_suppkey FROM supplier) s ON a.c_nationkey = s.s_nationkey GROUP BY 1""",
)
def many_to_many(t: Tables):
    left = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    right = t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    return factorised_join(left, right, ["c_nationkey"], weight="pairs")


def _edge(x1: str, y1: str, x2: str, y2: str) -> str:
    a, b = f"tan(radians({y1}) / 2)", f"tan(radians({y2}) / 2)"
    return f"2 * atan(tan(radians(({x2}) - ({x1})) / 2) * ({a} + {b}) / (1 + {a} * {b}))"


def _ring_sql(points: list[tuple[str, str]]) -> str:
    edges = " + ".join(_edge(*p, *q) for p, q in zip(points, points[1:] + points[:1]))
    return f"abs({edges})"


OUTER_SQL = _ring_sql([("x", "y"), ("x + w", "y + 0.1"), ("x + w * 1.1", "y + w"), ("x + 0.05", "y + w * 0.9")])
HOLE_SQL = _ring_sql([("x + 0.2", "y + 0.2"), ("x + 0.3", "y + 0.2"), ("x + 0.3", "y + 0.3"), ("x + 0.2", "y + 0.3")])
ISLAND_SQL = _ring_sql([("x + 3.0", "y"), ("x + 3.4", "y + 0.1"), ("x + 3.1", "y + 0.5")])
CORNERS_SQL = "(SELECT *, c_acctbal / 200.0 AS x, (c_custkey % 6000) / 100.0 - 30.0 AS y, 0.5 + c_nationkey / 50.0 AS w FROM customer)"


@query(
    "n3_polygon_area",
    f"""SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip, count(*) AS n, round(sum(({OUTER_SQL} - {HOLE_SQL}) * 6371.01 * 6371.01), 3) AS km2
        FROM {CORNERS_SQL} GROUP BY 1""",
)
def areas_of_polygons(t: Tables):
    rows = t.rings().select("zip", polygon_area("rings").alias("m2"))
    return rows.groupBy("zip").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("m2") / 1e6, 3).alias("km2"))


def change_sql(pattern: str, period: str, base: list[str], plot: list[str], change: str, body: str) -> str:
    where = "" if pattern == "all" else f"WHERE regexp_matches(uID, '{pattern}')"
    diff = "mean_x - mean_y" if change == "abs" else "(mean_x - mean_y) / nullif(mean_y, 0)"
    return sql_on("monthly", extra={
        "means": f"""SELECT ZIP, {period} AS period, year, avg(exposure) AS mean_x,
                     CAST(year AS VARCHAR) || '.' || CAST({period} AS VARCHAR) AS yt FROM monthly {where} GROUP BY 1, 2, 3, 5""",
        "known": "SELECT m.* FROM means m JOIN nation ON ZIP = lpad(CAST(n_nationkey AS VARCHAR), 5, '0')",
        "changes": f"""SELECT a.ZIP, a.period, a.year, mean_x, mean_y, (mean_x - mean_y) / nullif(mean_y, 0) AS frac, {diff} AS change
                       FROM known a LEFT JOIN (SELECT ZIP, period, mean_x AS mean_y FROM known WHERE yt IN {tuple(base)}) b
                       ON a.ZIP = b.ZIP AND a.period = b.period WHERE yt IN {tuple(plot)}""",
    }, body=body)


QUARTER_BASE = ["1997.3", "1997.4", "1998.1", "1998.2"]
QUARTER_PLOT = ["1998.3", "1998.4", "1999.1", "1999.2"]
MONTH_BASE = [f"1998.{m}" for m in range(1, 13)]
MONTH_PLOT = [f"1999.{m}" for m in range(1, 13)]
_ROWS = f"SELECT ZIP, period, year, {settled_sql('mean_x', 4)} AS mean_x, {settled_sql('mean_y', 4)} AS mean_y, {settled_sql('change', 5)} AS change FROM changes"


def quarterly_change(t: Tables):
    return change_from_base(t.monthly(), _areas(t), "R|A-F", "quarter", 1997, 3, "abs")


def monthly_change(t: Tables):
    return change_from_base(t.monthly(), _areas(t), "N-O", "month", 1998, None, "pct")


def _rounded(df):
    return df.select(
        "ZIP", "period", "year", settled("mean_x", 4).alias("mean_x"), settled("mean_y", 4).alias("mean_y"), settled("change", 5).alias("change")
    )


@query("n4_change_from_base_quarterly", change_sql("R|A-F", "quarter", QUARTER_BASE, QUARTER_PLOT, "abs", _ROWS))
def change_quarterly(t: Tables):
    return _rounded(quarterly_change(t))


@query("n4_change_from_base_monthly", change_sql("N-O", "month", MONTH_BASE, MONTH_PLOT, "pct", _ROWS))
def change_monthly(t: Tables):
    return _rounded(monthly_change(t))


_MEAN = "CASE WHEN count(*) = count(frac) THEN avg(frac) END"
LABELS = f"SELECT period, year, round(m, 6) AS mean_p, {LABEL_SQL.format(m='m')} AS label FROM (SELECT period, year, {_MEAN} AS m FROM changes GROUP BY 1, 2)"


@query("q7_change_map_labels", change_sql("R|A-F", "quarter", QUARTER_BASE, QUARTER_PLOT, "abs", LABELS))
def change_labels(t: Tables):
    return mean_change_labels(quarterly_change(t)).withColumn("mean_p", F.round("mean_p", 6))


@query("q7_change_map_labels_monthly", change_sql("N-O", "month", MONTH_BASE, MONTH_PLOT, "pct", LABELS))
def change_labels_monthly(t: Tables):
    return mean_change_labels(monthly_change(t)).withColumn("mean_p", F.round("mean_p", 6))

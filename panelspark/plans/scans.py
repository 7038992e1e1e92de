"""A: scans, sinks and generated tables. Text files are written from the given tables, then scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import pad_code
from ..models import ols
from ..operators.cohort import observed_in_all
from ..operators.joins import left_join
from ..operators.spatial import polygon_area
from ..session import scratch_path
from ..sources.tables import (
    BOUNDARY_SCHEMA, id_table, load_cohort, period_dim, read_boundaries, read_delimited, read_spreadsheet_export,
    save_cohort, wkb_of_parts, write_delimited,
)
from .estimators import DID_SQL
from .frames import Tables, sql_on
from .places import CORNERS_SQL, HOLE_SQL, ISLAND_SQL, OUTER_SQL
from .registry import query


@query(
    "a1_delimited_scan",
    "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(CAST(o_orderdate AS DATE)) AS last_day "
    "FROM orders GROUP BY o_orderpriority",
)
def delimited_scan(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority", "o_totalprice")
    path = write_delimited(rows, scratch_path(t.spark, "orders-csv"))
    back = read_delimited(t.spark, path, "o_orderkey bigint, day date, o_orderpriority string, o_totalprice double")
    return back.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("day").alias("last_day")
    )


@query(
    "a2_scan_keeps_leading_zeros",
    "SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip, count(*) AS n FROM customer GROUP BY 1",
)
def leading_zeros(t: Tables):
    path = write_delimited(t.customer.select("c_custkey", pad_code("c_nationkey").alias("zip")), scratch_path(t.spark, "codes-csv"))
    return read_delimited(t.spark, path, "c_custkey bigint, zip string").groupBy("zip").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a3_spreadsheet_export",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day "
    "FROM orders GROUP BY 1",
)
def spreadsheet_export(t: Tables):
    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    path = write_delimited(t.orders.select("o_orderkey", serial.alias("Date")), scratch_path(t.spark, "sheet-csv"))
    back = read_spreadsheet_export(t.spark, path, "o_orderkey bigint, Date int", ["Date"])
    return back.groupBy(F.year("Date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("first_day"))


@query(
    "a4_boundary_table",
    f"""SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS ZCTA5CE10, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS land,
        round(sum(({OUTER_SQL} - {HOLE_SQL} + {ISLAND_SQL}) * 6371.01 * 6371.01), 3) AS km2 FROM {CORNERS_SQL} GROUP BY 1""",
)
def boundary_table(t: Tables):
    parts = wkb_of_parts(F.array(F.col("rings"), F.array("island")))
    made = t.rings().withColumns({"ZCTA5CE10": F.col("zip"), "ALAND10": F.col("c_custkey"), "geometry": parts})
    fields = [f.split(" ", 1) for f in BOUNDARY_SCHEMA.split(", ")]
    have = {"ZCTA5CE10", "ALAND10", "geometry"}
    out = made.select(*[F.col(n) if n in have else F.lit(None).cast(ty).alias(n) for n, ty in fields])
    path = scratch_path(t.spark, "boundaries")
    out.write.parquet(path)
    areas = read_boundaries(t.spark, path).groupBy("ZCTA5CE10")
    return areas.agg(F.count(F.lit(1)).alias("n"), F.sum("ALAND10").alias("land"), F.round(F.sum(polygon_area("rings")) / 1e6, 3).alias("km2"))


@query(
    "a5_persist_cohort",
    """SELECT uid AS ids FROM (SELECT o_custkey AS uid, max(CASE WHEN year(o_orderdate) = 1996 THEN 1 ELSE 0 END) AS a,
       max(CASE WHEN year(o_orderdate) = 1997 THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1) WHERE a = 1 AND b = 1""",
)
def persist_cohort(t: Tables):
    seen = t.orders.select(F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("year"))
    ids = id_table(observed_in_all(seen, "uid", "year", [1996, 1997]), "uid")
    return load_cohort(t.spark, save_cohort(ids, scratch_path(t.spark, "cohort")))


@query("a6_id_table", "SELECT o_custkey AS ids FROM orders")
def ids_of(t: Tables):
    return id_table(t.orders, "o_custkey")


@query(
    "a7_period_dimension",
    """SELECT d.date, CAST(year(d.date) AS INTEGER) AS year, CAST(quarter(d.date) AS INTEGER) AS quarter, coalesce(n, 0) AS n
       FROM (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2002-10-01', INTERVAL 3 MONTH)) AS DATE) AS date) d
       LEFT JOIN (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) o
       ON d.date = o.date""",
)
def calendar(t: Tables):
    dim = period_dim(t.spark, "1994-01-01", "2002-10-01", "quarter").select("date", "year", "quarter")
    n = t.orders.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return left_join(dim, n, ["date"]).withColumn("n", F.coalesce("n", F.lit(0)))


@query("a8_contrast_table", DID_SQL + " WHERE term IN ('(Intercept)', 'coalclose')")
def contrast_table(t: Tables):
    fit = ols(t.event_panel(), "asthma_count", ["coalclose", "exposed", "exposed_coalclose"])
    out = fit.table().limit(2).select("term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"))
    fit.release()
    return out

"""J and K: dates, event windows, calendar roll-ups, keys and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import (
    base_periods, days_since, event_window, from_serial, month_date, month_name, parse_us_date, quarter_label, stratum,
    weekday_name,
)
from ..functions.nulls import strict_avg, strict_sum
from ..functions.text import key, pad_code, plant_code, reduction_label, unit_code, unit_title
from ..operators.aggregates import period_apply
from .frames import EVENT, Tables, sql_on
from .registry import query, settled, settled_sql


@query("j1_parse_date", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
def parsed(t: Tables):
    text = F.date_format("o_orderdate", "M/d/yyyy")
    return t.orders.groupBy(parse_us_date(text).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j2_from_serial",
    "SELECT o_orderkey, DATE '1899-12-30' + CAST(o_orderkey AS INTEGER) AS day, DATE '1900-01-01' + CAST(o_orderkey AS INTEGER) AS literal_day FROM orders",
)
def serials(t: Tables):
    return t.orders.select(
        "o_orderkey", from_serial("o_orderkey").alias("day"), from_serial("o_orderkey", "1900-01-01").alias("literal_day")
    )


@query(
    "j3_calendar_parts",
    "SELECT monthname(o_orderdate) AS month, dayname(o_orderdate) AS dow, CAST(year(o_orderdate) AS INTEGER) AS year, "
    "CAST(month(o_orderdate) AS INTEGER) AS month_no, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4",
)
def calendar_parts(t: Tables):
    d = "o_orderdate"
    return t.orders.groupBy(
        month_name(d).alias("month"), weekday_name(d).alias("dow"), F.year(d).alias("year"), F.month(d).alias("month_no")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j4_days_since",
    "SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS date2, "
    "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) - 1254 AS time_since FROM orders",
)
def day_counts(t: Tables):
    d = days_since(F.col("o_orderdate").cast("date"), "1995-01-01")
    return t.orders.select("o_orderkey", d.alias("date2"), (d - 1254).alias("time_since"))


@query(
    "j5_period_apply_person_month",
    sql_on("person_days", body=f"""SELECT uid, CAST(date_trunc('month', Date) AS DATE) AS period, max(Date) AS date_last,
           {settled_sql('avg(Rscu)', 8)} AS rscu, CASE WHEN count(*) = count(Mold) THEN {settled_sql('avg(Mold)', 6)} END AS mold,
           round(sum(Rscu), 7) AS rscu_sum FROM person_days GROUP BY 1, 2"""),
)
def person_months(t: Tables):
    return period_apply(t.person_days(), ["uid"], "Date", "month", {
        "rscu": settled(strict_avg("Rscu"), 8), "mold": settled(strict_avg("Mold"), 6), "rscu_sum": F.round(strict_sum("Rscu"), 7),
    })


@query(
    "j5_period_apply_pooled_week",
    f"SELECT CAST(date_trunc('week', ts) AS DATE) AS period, max(CAST(ts AS DATE)) AS date_last, {settled_sql('avg(value)', 6)} AS mean_value, count(*) AS n FROM events GROUP BY 1",
)
def pooled_weeks(t: Tables):
    return period_apply(t.events, [], "ts", "week", {"mean_value": settled(strict_avg("value"), 6), "n": F.count(F.lit(1))})


@query(
    "j6_event_window",
    """SELECT side, count(*) AS n FROM (SELECT CASE WHEN d > -365 AND d <= 0 THEN 1 WHEN d > 0 AND d < 365 THEN 2 ELSE 0 END AS side
       FROM (SELECT date_diff('day', DATE '1998-06-08', CAST(o_orderdate AS DATE)) AS d FROM orders)) GROUP BY side""",
)
def sides_of_event(t: Tables):
    side = event_window(F.col("o_orderdate").cast("date"), EVENT, 365, 365)
    return t.orders.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j7_strata",
    """SELECT CAST(year(o_orderdate) AS VARCHAR) || ':' || CAST(month(o_orderdate) AS VARCHAR) || ':' || dayname(o_orderdate) AS stratum,
       CAST(year(o_orderdate) AS VARCHAR) || ':' || CAST(month(o_orderdate) AS VARCHAR) AS moyr, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def strata(t: Tables):
    d = "o_orderdate"
    return t.orders.groupBy(stratum(d).alias("stratum"), stratum(d, weekday=False).alias("moyr")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j8_build_date",
    "SELECT make_date(year(o_orderdate), month(o_orderdate), 1) AS first_day, count(*) AS n FROM orders GROUP BY 1",
)
def built_dates(t: Tables):
    return t.orders.groupBy(month_date(F.year("o_orderdate"), F.month("o_orderdate")).alias("first_day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j9_base_periods",
    """SELECT yrq, CASE WHEN yrq IN ('1996-3', '1996-4', '1997-1', '1997-2') THEN 'base' ELSE 'plot' END AS part, count(*) AS n
       FROM (SELECT CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(quarter(o_orderdate) AS VARCHAR) AS yrq FROM orders)
       WHERE yrq IN ('1996-3', '1996-4', '1997-1', '1997-2', '1997-3', '1997-4', '1998-1', '1998-2') GROUP BY 1, 2""",
)
def windows_of_periods(t: Tables):
    base, plot = base_periods(1996, 3, 4)
    y, q = F.year("o_orderdate"), F.quarter("o_orderdate")
    part = F.when(base.contains(y, q), "base").when(plot.contains(y, q), "plot")
    rows = t.orders.select(quarter_label("o_orderdate").alias("yrq"), part.alias("part")).filter(F.col("part").isNotNull())
    return rows.groupBy("yrq", "part").agg(F.count(F.lit(1)).alias("n"))


_K_NAMES = {"A": "Alpha", "R": "Romeo"}


@query(
    "k1_unit_pieces",
    """SELECT l_returnflag AS plant, l_linestatus AS unit, CASE l_returnflag WHEN 'A' THEN 'Alpha Unit ' || l_linestatus
       WHEN 'R' THEN 'Romeo Unit ' || l_linestatus ELSE 'Select units''' END AS title, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
)
def unit_pieces(t: Tables):
    rows = t.lineitem.select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("uid"))
    return rows.groupBy(
        plant_code("uid").alias("plant"), unit_code("uid").alias("unit"), unit_title("uid", _K_NAMES).alias("title")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "k2_composite_keys",
    "SELECT CAST(year(o_orderdate) AS VARCHAR) || '.' || CAST(month(o_orderdate) AS VARCHAR) AS year_time, count(*) AS n FROM orders GROUP BY 1",
)
def keys(t: Tables):
    k = key(F.year("o_orderdate"), F.month("o_orderdate"))
    return t.orders.groupBy(k.alias("year_time")).agg(F.count(F.lit(1)).alias("n"))


@query("k3_zero_pad", "SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip FROM customer")
def padded(t: Tables):
    return t.customer.select("c_custkey", pad_code("c_nationkey").alias("zip"))


LABEL_SQL = """'mean reduction = ' || CASE WHEN {m} > 0 THEN '-' || CAST(CAST(round_even({m} * 100 / 2, 0) AS BIGINT) * 2 AS VARCHAR)
               ELSE CAST(CAST(round_even(abs({m}) * 100 / 2, 0) AS BIGINT) * 2 AS VARCHAR) END || '%'"""


@query(
    "k4_percent_label",
    f"SELECT o_orderkey, {LABEL_SQL.format(m='m')} AS label FROM (SELECT o_orderkey, (o_totalprice - 250000) / 250000 AS m FROM orders)",
)
def labels(t: Tables):
    m = (F.col("o_totalprice") - 250000) / 250000
    return t.orders.select("o_orderkey", reduction_label(m).alias("label"))

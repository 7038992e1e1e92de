"""Panels built from the order tables, and the same panels as SQL common table expressions.

Nations play the areas, return flag x line status the plant units, orders the outcome counts,
customers the population, and order dates the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import row_total, step_events
from ..functions.dates import quarter_label
from ..functions.text import pad_code
from ..operators.contrasts import exposed_groups
from ..operators.joins import left_join
from ..operators.reshape import pivot_units
from ..operators.windows import group_sequence
from ..session import handed_over
from ..sources.tables import read_table

UNITS = ["A-F", "A-O", "N-F", "N-O", "R-F", "R-O"]
UNIT_COLUMNS = ["plant_" + u.replace("-", "_") for u in UNITS]
EXPOSURE_UNITS = ["plant_A_F", "plant_A_O", "plant_R_F", "plant_R_O"]
CLOSING_UNITS = ["plant_A_F", "plant_R_F", "plant_R_O"]
STEPS = {"scrub0": 6, "scrub1": 12, "scrub2": 14, "scrub3": 18}
EVENT = "1998-06-08"
PRE_QUARTERS = ["1997-2", "1997-3", "1997-4", "1998-1"]
POST_QUARTERS = ["1998-3", "1998-4", "1999-1", "1999-2"]
PRE_RANGE = ("1997-04-01", "1998-07-01")  # the four quarters and the quarter of the event
EVENT_QUARTERS = ["1997-2", "1997-3", "1997-4", "1998-1", "1998-2", "1998-3", "1998-4", "1999-1", "1999-2"]
WEATHER = ["RH_Quarter", "Pres_Quarter", "WS_Quarter", "Temp_Quarter"]


def exposure_groups_of(panel: DataFrame) -> DataFrame:
    """(zip, pre_hyads, exposed) from the rows of an area-quarter table up to the quarter of the event."""
    pre = F.col("yrq").isin([q for q in EVENT_QUARTERS if q not in POST_QUARTERS])
    groups = exposed_groups(panel.filter(pre), ["zip"], F.lit(True), "hyads_tot")
    return groups.select("zip", (F.col("pre_exposure") / 1000).alias("pre_hyads"), "exposed")


class Tables:
    """The given tables by name, and the panels derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = read_table(self.spark, self.folder, name)
        self.__dict__[name] = table  # the footer is read once
        return table

    def area_orders(self, within: tuple[str, str] | None = None) -> DataFrame:
        """Orders with the area code and calendar columns of their customer, optionally of one date range."""
        day = F.col("o_orderdate").cast("date")
        area = self.customer.select(F.col("c_custkey").alias("o_custkey"), pad_code("c_nationkey").alias("zip"))
        orders = self.orders
        if within:
            start, end = (F.lit(d).cast("timestamp_ntz") for d in within)
            orders = orders.filter((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end))
        return orders.join(area, "o_custkey").withColumns(
            {"day": day, "year": F.year(day), "qtr": F.quarter(day), "month": F.month(day), "yrq": quarter_label(day)}
        )

    def unit_rows(self, within: tuple[str, str] | None = None) -> DataFrame:
        """Line items with area, unit and calendar columns."""
        unit = F.concat_ws("-", "l_returnflag", "l_linestatus")
        items = self.lineitem.select(
            F.col("l_orderkey").alias("o_orderkey"), unit.alias("uid"), "l_extendedprice", "l_quantity", "l_discount", "l_tax"
        )
        orders = self.area_orders(within).select("o_orderkey", "zip", "day", "year", "qtr", "month", "yrq")
        return items.join(orders, "o_orderkey")

    def exposure(self, within: tuple[str, str] | None = None) -> DataFrame:
        """(zip, year, qtr, yrq, uid, exp_qtr): quarterly exposure per area and unit."""
        return self.unit_rows(within).groupBy("zip", "year", "qtr", "yrq", "uid").agg(F.sum("l_extendedprice").alias("exp_qtr"))

    def monthly(self) -> DataFrame:
        """(ZIP, date_month, year, month, quarter, uID, exposure): monthly exposure per area and unit."""
        rows = self.unit_rows().select(
            F.col("zip").alias("ZIP"), F.trunc("day", "month").alias("date_month"), F.col("uid").alias("uID"), "l_extendedprice"
        )
        sums = rows.groupBy("ZIP", "date_month", "uID").agg(F.sum("l_extendedprice").alias("exposure"))
        return sums.select(
            "ZIP", "date_month", F.year("date_month").alias("year"), F.month("date_month").alias("month"),
            F.quarter("date_month").alias("quarter"), "uID", "exposure",
        )

    def area_quarters(self) -> DataFrame:
        """Outcome count and the four weather means per area and quarter, from one join and one aggregation."""
        return self.area_orders().groupBy("zip", "year", "qtr", "yrq").agg(
            F.count(F.lit(1)).alias("asthma_count"),
            (F.avg("o_totalprice") / 1000).alias("RH_Quarter"),
            (F.avg((F.col("o_orderstatus") == "F").cast("double")) * 100).alias("Pres_Quarter"),
            F.avg(F.dayofmonth("day").cast("double")).alias("WS_Quarter"),
            (F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")) * 100).alias("Temp_Quarter"),
        )

    def counts(self) -> DataFrame:
        """(zip, yrq, asthma_count): outcome count per area and quarter."""
        return self.area_quarters().select("zip", "yrq", "asthma_count")

    def demographics(self) -> DataFrame:
        """(zcta5a, year, totpop, pov_p, uninsur_p, black_p): customers active in an area and year."""
        c = self.customer
        active = self.orders.select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).distinct()
        people = active.join(c, "c_custkey")
        share = lambda s: F.avg((F.col("c_mktsegment") == s).cast("double")) * 100
        return people.groupBy(pad_code("c_nationkey").alias("zcta5a"), "year").agg(
            F.count(F.lit(1)).alias("totpop"),
            (F.avg("c_acctbal") / 100).alias("pov_p"),
            share("BUILDING").alias("uninsur_p"),
            share("MACHINERY").alias("black_p"),
        )

    def weather(self) -> DataFrame:
        """(Zip2010, Yr, qtrSeq, four quarterly means)."""
        return self.area_quarters().select(
            F.col("zip").alias("Zip2010"), F.col("year").alias("Yr"), F.col("qtr").alias("qtrSeq"), *WEATHER
        )

    def wide(self, within: tuple[str, str] | None = None) -> DataFrame:
        """One column per unit; the rows are area x quarter."""
        return pivot_units(self.exposure(within), ["zip", "year", "qtr", "yrq"], "uid", "exp_qtr", UNITS, UNIT_COLUMNS)

    def panel(self) -> DataFrame:
        """Area x quarter panel: exposures, outcome, demographics, weather, time and event steps."""
        p = left_join(self.wide(), self.area_quarters(), ["zip", "year", "qtr", "yrq"])
        p = left_join(p, self.demographics(), {"zip": "zcta5a", "year": "year"})
        p = row_total(p, "tot_exp", EXPOSURE_UNITS)
        p = row_total(p, "hyads_tot", CLOSING_UNITS)
        p = group_sequence(p, "zip", "yrq")
        return step_events(p, "time", STEPS)

    def event_panel(self) -> DataFrame:
        """The nine quarters around the event with post flag, pre-period exposure group and products.

        Line items and orders are joined once: the area-quarters are handed over, and the groups are sums over them.
        """
        p = handed_over(self.panel().filter(F.col("yrq").isin(EVENT_QUARTERS)), "event-rows")
        p = p.withColumn("coalclose", F.col("yrq").isin(POST_QUARTERS).cast("int"))
        p = left_join(p, exposure_groups_of(p), ["zip"])
        return p.withColumns({
            "exposed_coalclose": F.col("exposed") * F.col("coalclose"),
            "exposed_coalclose_c": F.col("pre_hyads") * F.col("coalclose"),
        })

    def exposure_groups(self) -> DataFrame:
        """(zip, pre_hyads, exposed) from the quarters before the event; only those orders are scanned."""
        return exposure_groups_of(row_total(self.wide(PRE_RANGE), "hyads_tot", CLOSING_UNITS))

    def person_days(self) -> DataFrame:
        """(uid, Date, Rscu, Mold, WindSpeed, RelativeHumidity): one row per order; some Mold values are missing."""
        day = F.col("o_orderdate").cast("date")
        return self.orders.select(
            F.col("o_custkey").alias("uid"), day.alias("Date"), (F.col("o_totalprice") / 100000).alias("Rscu"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.dayofmonth(day).cast("double")).alias("Mold"),
            (F.col("o_orderkey") % 97).cast("double").alias("WindSpeed"),
            F.dayofyear(day).cast("double").alias("RelativeHumidity"),
        )

    def person_months(self) -> DataFrame:
        """Person x month panel with month index, step and interaction."""
        from ..functions.columns import period_index

        m = self.person_days().groupBy("uid", F.trunc("Date", "month").alias("period")).agg(
            F.avg("Rscu").alias("Rscu"), F.sum("Rscu").alias("Rscu_sum"), F.avg("WindSpeed").alias("WindSpeed"),
            F.avg("RelativeHumidity").alias("RelativeHumidity"), F.max("Date").alias("Date"),
        )
        m = m.withColumns({"month": F.month("period"), "t": period_index(F.year("period"), F.month("period"), (1995, 1), 12, 84)})
        m = m.withColumn("scrub4", (F.col("t") > 41).cast("int"))
        return m.withColumns({"t_scrub4": F.col("t") * F.col("scrub4"), "Rscu_bi": (F.col("Rscu") > 2.5).cast("int")})

    def rings(self) -> DataFrame:
        """(zip, c_custkey, rings, island): a quadrilateral with a square hole per customer, in degrees, and a triangle beside it."""
        x = F.col("c_acctbal") / 200.0
        y = (F.col("c_custkey") % 6000) / 100.0 - 30.0
        w = F.lit(0.5) + F.col("c_nationkey") / 50.0

        def pt(dx, dy):
            return F.struct((x + dx).alias("x"), (y + dy).alias("y"))

        outer = F.array(pt(F.lit(0.0), F.lit(0.0)), pt(w, F.lit(0.1)), pt(w * 1.1, w), pt(F.lit(0.05), w * 0.9), pt(F.lit(0.0), F.lit(0.0)))
        h = lambda a: F.lit(0.2 + a)
        hole = F.array(pt(h(0), h(0)), pt(h(0), h(0.1)), pt(h(0.1), h(0.1)), pt(h(0.1), h(0)), pt(h(0), h(0)))
        island = F.array(pt(F.lit(3.0), F.lit(0.0)), pt(F.lit(3.4), F.lit(0.1)), pt(F.lit(3.1), F.lit(0.5)), pt(F.lit(3.0), F.lit(0.0)))
        return self.customer.select(pad_code("c_nationkey").alias("zip"), "c_custkey", F.array(outer, hole).alias("rings"), island.alias("island"))


_PIVOT = ",\n".join(
    f"max(CASE WHEN uid = '{u}' THEN exp_qtr END) AS {c}" for u, c in zip(UNITS, UNIT_COLUMNS)
)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


CTE = {
    "area_orders": """
        SELECT o.*, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip, CAST(o_orderdate AS DATE) AS day,
               CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS qtr,
               CAST(month(o_orderdate) AS INTEGER) AS month,
               CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(quarter(o_orderdate) AS VARCHAR) AS yrq
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "unit_rows": """
        SELECT l.*, a.zip, a.day, a.year, a.qtr, a.month, a.yrq, l_returnflag || '-' || l_linestatus AS uid
        FROM lineitem l JOIN area_orders a ON l.l_orderkey = a.o_orderkey""",
    "exposure": """
        SELECT zip, year, qtr, yrq, uid, sum(l_extendedprice) AS exp_qtr
        FROM unit_rows GROUP BY zip, year, qtr, yrq, uid""",
    "monthly": """
        SELECT zip AS ZIP, CAST(date_trunc('month', day) AS DATE) AS date_month, year, month, qtr AS quarter,
               uid AS uID, sum(l_extendedprice) AS exposure
        FROM unit_rows GROUP BY 1, 2, 3, 4, 5, 6""",
    "counts": "SELECT zip, yrq, count(*) AS asthma_count FROM area_orders GROUP BY zip, yrq",
    "demographics": """
        SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zcta5a, year, count(*) AS totpop, avg(c_acctbal) / 100 AS pov_p,
               avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) * 100 AS uninsur_p,
               avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END) * 100 AS black_p
        FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) a
        JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "weather": """
        SELECT zip AS Zip2010, year AS Yr, qtr AS qtrSeq, avg(o_totalprice) / 1000 AS RH_Quarter,
               avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) * 100 AS Pres_Quarter,
               avg(CAST(day(day) AS DOUBLE)) AS WS_Quarter,
               avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) * 100 AS Temp_Quarter
        FROM area_orders GROUP BY 1, 2, 3""",
    "wide": f"SELECT zip, year, qtr, yrq, {_PIVOT} FROM exposure GROUP BY zip, year, qtr, yrq",
    "panel": f"""
        SELECT w.*, asthma_count, totpop, pov_p, uninsur_p, black_p, RH_Quarter, Pres_Quarter, WS_Quarter, Temp_Quarter,
               {' + '.join(EXPOSURE_UNITS)} AS tot_exp, {' + '.join(CLOSING_UNITS)} AS hyads_tot,
               CAST(row_number() OVER (PARTITION BY w.zip ORDER BY w.yrq) AS INTEGER) AS time
        FROM wide w LEFT JOIN counts n ON w.zip = n.zip AND w.yrq = n.yrq
        LEFT JOIN demographics d ON w.zip = d.zcta5a AND w.year = d.year
        LEFT JOIN weather e ON w.zip = e.Zip2010 AND w.year = e.Yr AND w.qtr = e.qtrSeq""",
    "event_rows": f"""
        SELECT *, CASE WHEN yrq IN {_in(POST_QUARTERS)} THEN 1 ELSE 0 END AS coalclose
        FROM panel WHERE yrq IN {_in(EVENT_QUARTERS)}""",
    "pre_sums": """
        SELECT zip, CASE WHEN count(*) = count(hyads_tot) THEN sum(hyads_tot) END AS pre_exposure
        FROM event_rows WHERE coalclose = 0 GROUP BY zip""",
    "groups": """
        SELECT zip, pre_exposure / 1000 AS pre_hyads,
               CASE WHEN pre_exposure >= (SELECT avg(pre_exposure) FROM pre_sums) THEN 1
                    WHEN pre_exposure IS NOT NULL THEN 0 END AS exposed
        FROM pre_sums""",
    "event_panel": """
        SELECT r.*, pre_hyads, exposed, exposed * coalclose AS exposed_coalclose, pre_hyads * coalclose AS exposed_coalclose_c
        FROM event_rows r LEFT JOIN groups g ON r.zip = g.zip""",
    "person_days": """
        SELECT o_custkey AS uid, CAST(o_orderdate AS DATE) AS Date, o_totalprice / 100000 AS Rscu,
               CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(day(o_orderdate) AS DOUBLE) END AS Mold,
               CAST(o_orderkey % 97 AS DOUBLE) AS WindSpeed, CAST(dayofyear(o_orderdate) AS DOUBLE) AS RelativeHumidity
        FROM orders""",
    "person_months": """
        SELECT m.*, CAST(month(period) AS INTEGER) AS month,
               CAST((year(period) - 1995) * 12 + month(period) AS INTEGER) AS t,
               CASE WHEN (year(period) - 1995) * 12 + month(period) > 41 THEN 1 ELSE 0 END AS scrub4
        FROM (SELECT uid, CAST(date_trunc('month', Date) AS DATE) AS period, avg(Rscu) AS Rscu, sum(Rscu) AS Rscu_sum,
                     avg(WindSpeed) AS WindSpeed, avg(RelativeHumidity) AS RelativeHumidity, max(Date) AS Date
              FROM person_days GROUP BY 1, 2) m""",
}
_NEEDS = {
    "unit_rows": ["area_orders"], "exposure": ["unit_rows"], "monthly": ["unit_rows"], "counts": ["area_orders"],
    "weather": ["area_orders"], "wide": ["exposure"], "panel": ["wide", "counts", "demographics", "weather"],
    "event_rows": ["panel"], "pre_sums": ["event_rows"], "groups": ["pre_sums"], "event_panel": ["event_rows", "groups"],
    "person_months": ["person_days"],
}


def sql_on(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """`body` behind the named common table expressions and everything they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _NEEDS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return f"WITH {', '.join(parts)}\n{body}"

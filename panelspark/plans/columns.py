"""B and L: projections, derived columns, math and feature bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bases import harmonics, natural_spline_basis
from ..functions.columns import (
    absolute_change, cut_points, interaction, lookup, period_index, relabel, relative_change, rescale, row_total,
    share_of_total, step_events, treatment_dummies, value_dummies,
)
from ..functions.nulls import indicator
from ..operators.ranks import exact_quantiles, global_row_number
from .frames import STEPS, UNIT_COLUMNS, UNITS, Tables, sql_on
from .registry import query


@query("b1_select", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def select_columns(t: Tables):
    return t.orders.select("o_totalprice", "o_custkey", "o_orderkey")


@query("b2_drop", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_column(t: Tables):
    return t.customer.drop("c_name")


@query("b3_positional_slice", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def positional_slice(t: Tables):
    df = t.customer
    return df.select(df.columns[2:5])


@query("b4_rename", "SELECT s_suppkey AS id, s_name, s_nationkey AS zip, s_acctbal FROM supplier")
def rename(t: Tables):
    return t.supplier.withColumnsRenamed({"s_suppkey": "id", "s_nationkey": "zip"})


@query("b5_rename_all", "SELECT p_partkey AS a, p_name AS b, p_brand AS c, p_type AS d, p_size AS e, p_retailprice AS f FROM part")
def rename_all(t: Tables):
    return t.part.toDF("a", "b", "c", "d", "e", "f")


@query(
    "b6_cast",
    "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cust, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, "
    "TRY_CAST(o_orderpriority AS INTEGER) AS bad FROM orders",
)
def casts(t: Tables):
    return t.orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("cust"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("rank"), F.col("o_orderpriority").try_cast("int").alias("bad"),
    )


@query(
    "b7_rescale",
    "SELECT o_orderkey, o_totalprice / 1000 AS o_totalprice, (o_totalprice / 1000) / -1 AS neg, o_totalprice AS copy FROM orders",
)
def rescaled(t: Tables):
    df = t.orders.select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("copy"))
    df = rescale(df, ["o_totalprice"], 1000)
    return rescale(df.withColumn("neg", F.col("o_totalprice")), ["neg"], -1)


@query(
    "b8_row_total",
    sql_on("wide", body="SELECT zip, yrq, round(plant_A_F + plant_A_O + plant_N_F + plant_N_O + plant_R_F + plant_R_O, 2) AS tot_exp FROM wide"),
)
def composite(t: Tables):
    w = row_total(t.wide(), "tot_exp", UNIT_COLUMNS)
    return w.select("zip", "yrq", F.round("tot_exp", 2).alias("tot_exp"))


@query("b9_interaction", "SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS prod FROM lineitem")
def product(t: Tables):
    return interaction(t.lineitem, "prod", "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", "prod")


@query(
    "b10_indicator",
    sql_on("person_days", body="SELECT high, count(*) AS n FROM (SELECT CASE WHEN Mold > 15 THEN 1 WHEN Mold <= 15 THEN 0 END AS high FROM person_days) GROUP BY high"),
)
def flags(t: Tables):
    return t.person_days().select(indicator(F.col("Mold") > 15).alias("high")).groupBy("high").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b11_step_events",
    sql_on("wide", body="SELECT zip, time, " + ", ".join(f"CASE WHEN time > {k} THEN 1 ELSE 0 END AS {n}" for n, k in STEPS.items())
           + " FROM (SELECT zip, CAST(row_number() OVER (PARTITION BY zip ORDER BY yrq) AS INTEGER) AS time FROM wide)"),
)
def steps(t: Tables):
    from ..operators.windows import group_sequence

    w = group_sequence(t.wide().select("zip", "yrq"), "zip", "yrq")
    return step_events(w, "time", STEPS).select("zip", "time", *STEPS)


@query(
    "b12_year_dummies",
    "SELECT o_orderkey, " + ", ".join(f"CASE WHEN year(o_orderdate) = {y} THEN 1 ELSE 0 END AS y{y}" for y in range(1996, 2001)) + " FROM orders",
)
def year_dummies(t: Tables):
    df = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))
    return value_dummies(df, "year", list(range(1996, 2001)), "y").drop("year")


@query(
    "b13_case_when",
    "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN 'early' WHEN year(o_orderdate) > 1999 THEN 'late' END AS era FROM orders",
)
def multi_branch(t: Tables):
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", F.when(y < 1997, "early").when(y > 1999, "late").alias("era"))


@query(
    "b14_cut_points",
    sql_on("person_days", body="""
        SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN Mold < 8 THEN 0 WHEN Mold < 16 THEN 1 WHEN Mold < 24 THEN 2
        WHEN Mold >= 24 THEN 3 END AS bucket FROM person_days) GROUP BY bucket"""),
)
def buckets(t: Tables):
    return t.person_days().groupBy(cut_points("Mold", [8, 16, 24]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b15_period_index",
    """SELECT o_orderkey, CASE WHEN q BETWEEN 1 AND 20 THEN q END AS q_index, CASE WHEN m BETWEEN 1 AND 25 THEN m END AS m_index
       FROM (SELECT o_orderkey, CAST((year(o_orderdate) - 1996) * 4 + quarter(o_orderdate) AS INTEGER) AS q,
             CAST((year(o_orderdate) - 1997) * 12 + month(o_orderdate) - 4 AS INTEGER) AS m FROM orders)""",
)
def index_of_period(t: Tables):
    y = F.year("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        period_index(y, F.quarter("o_orderdate"), (1996, 1), 4, 20).alias("q_index"),
        period_index(y, F.month("o_orderdate"), (1997, 5), 12, 25).alias("m_index"),
    )


@query(
    "b16_fill_nulls",
    sql_on("person_days", body="SELECT filled, count(*) AS n FROM (SELECT coalesce(Mold, 0) AS filled FROM person_days) GROUP BY filled"),
)
def fill(t: Tables):
    return t.person_days().groupBy(F.coalesce("Mold", F.lit(0.0)).alias("filled")).agg(F.count(F.lit(1)).alias("n"))


_LABELS = ["Alpha, Unit F", "Alpha, Unit O", "November, Unit F", "November, Unit O"]


@query(
    "b17_relabel",
    """SELECT uid_f, uid_f_ord, count(*) AS n FROM (SELECT CASE l_returnflag || '-' || l_linestatus WHEN 'A-F' THEN 'Alpha, Unit F'
       WHEN 'A-O' THEN 'Alpha, Unit O' WHEN 'N-F' THEN 'November, Unit F' WHEN 'N-O' THEN 'November, Unit O' END AS uid_f,
       CASE l_returnflag || '-' || l_linestatus WHEN 'A-F' THEN 1 WHEN 'A-O' THEN 2 WHEN 'N-F' THEN 3 WHEN 'N-O' THEN 4 END AS uid_f_ord
       FROM lineitem) GROUP BY 1, 2""",
)
def factor_labels(t: Tables):
    u = t.lineitem.select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("uid"))
    return relabel(u, "uid", UNITS[:4], _LABELS).groupBy("uid_f", "uid_f_ord").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b18_level_order",
    """SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY m, o_orderpriority) AS INTEGER) AS level
       FROM (SELECT o_orderpriority, round(avg(o_totalprice), 2) AS m FROM orders GROUP BY 1)""",
)
def level_order(t: Tables):
    means = t.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("m"))
    return global_row_number(means, ["m", "o_orderpriority"], "level").select("o_orderpriority", F.col("level").cast("int").alias("level"))


@query("b19_constant", "SELECT c_custkey, 1 AS number FROM customer")
def constant(t: Tables):
    return t.customer.select("c_custkey", F.lit(1).alias("number"))


@query(
    "b20_share_of_total",
    sql_on("demographics", body="SELECT zcta5a, year, totpop, round(totpop / (SELECT sum(totpop) FROM demographics), 9) AS wts FROM demographics"),
)
def weights(t: Tables):
    d = t.demographics().select("zcta5a", "year", "totpop")
    return share_of_total(d, "totpop", "wts").withColumn("wts", F.round("wts", 9))


_NAMES = {"A": "Alpha", "N": "November"}


@query(
    "b21_lookup",
    """SELECT quarter, plant, count(*) AS n FROM (SELECT CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
       CASE l_returnflag WHEN 'A' THEN 'Alpha' WHEN 'N' THEN 'November' END AS plant FROM lineitem) GROUP BY 1, 2""",
)
def lookups(t: Tables):
    quarters = {m: (m - 1) // 3 + 1 for m in range(1, 13)}
    rows = t.lineitem.select(lookup(F.month("l_shipdate"), quarters).alias("quarter"), lookup("l_returnflag", _NAMES).alias("plant"))
    return rows.groupBy("quarter", "plant").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l1_math",
    sql_on("demographics", body="SELECT zcta5a, year, round(ln(totpop), 8) AS log_pop, round(abs(pov_p - 50), 2) AS dist FROM demographics"),
)
def math_columns(t: Tables):
    return t.demographics().select(
        "zcta5a", "year", F.round(F.log("totpop"), 8).alias("log_pop"), F.round(F.abs(F.col("pov_p") - 50), 2).alias("dist")
    )



@query(
    "l2_harmonics",
    "SELECT m, round(sin(2 * pi() * m / 12), 9) + 0.0 AS s1, round(sin(4 * pi() * m / 12), 9) + 0.0 AS s2, round(cos(2 * pi() * m / 12), 9) + 0.0 AS c1, "
    "round(cos(4 * pi() * m / 12), 9) + 0.0 AS c2, n FROM (SELECT CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n FROM orders GROUP BY 1)",
)
def harmonic_columns(t: Tables):
    by_month = t.orders.groupBy(F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    named = zip(["s1", "s2", "c1", "c2"], harmonics("m", 2, 12))
    return by_month.select("m", "n", *[(F.round(c, 9) + F.lit(0.0)).alias(n) for n, c in named])


_NS = """
    SELECT c_nationkey, round(sum(x), 6) AS b1, round(sum((cube(greatest(x, 0)) - cube(greatest(x - 1, 0)))
           - (cube(greatest(x - m, 0)) - cube(greatest(x - 1, 0))) / (1 - m)), 6) AS b2
    FROM (SELECT c_nationkey, (c_acctbal - lo) / (hi - lo) AS x, (mid - lo) / (hi - lo) AS m
          FROM customer, (SELECT min(c_acctbal) AS lo, quantile_cont(c_acctbal, 0.5) AS mid, max(c_acctbal) AS hi FROM customer))
    GROUP BY c_nationkey""".replace("cube(greatest(x, 0))", "power(greatest(x, 0), 3)").replace(
    "cube(greatest(x - 1, 0))", "power(greatest(x - 1, 0), 3)").replace("cube(greatest(x - m, 0))", "power(greatest(x - m, 0), 3)")


@query("l3_natural_spline", _NS)
def spline_columns(t: Tables):
    c = t.customer
    knots = list(exact_quantiles(c, "c_acctbal", [0.0, 0.5, 1.0], names=["lo", "mid", "hi"]).head())
    b1, b2 = natural_spline_basis("c_acctbal", knots)
    return c.groupBy("c_nationkey").agg(F.round(F.sum(b1), 6).alias("b1"), F.round(F.sum(b2), 6).alias("b2"))


@query(
    "l4_relative_change",
    "SELECT l_orderkey, l_linenumber, round((l_quantity - nullif(l_discount, 0)) / nullif(l_discount, 0), 6) AS rel, "
    "round(l_quantity - l_discount, 6) AS diff FROM lineitem",
)
def changes(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(relative_change("l_quantity", "l_discount"), 6).alias("rel"),
        F.round(absolute_change("l_quantity", "l_discount"), 6).alias("diff"),
    )


@query(
    "m13_treatment_dummies",
    "SELECT year, " + ", ".join(f"CASE WHEN qtr = {q} THEN 1 ELSE 0 END AS qtr_{q}" for q in (1, 3, 4)) + ", count(*) AS n "
    "FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, quarter(o_orderdate) AS qtr FROM orders) GROUP BY 1, 2, 3, 4",
)
def dummies(t: Tables):
    df = t.orders.select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("qtr"))
    out = treatment_dummies(df, "qtr", [2, 1, 3, 4], base=2)
    return out.groupBy("year", "qtr_1", "qtr_3", "qtr_4").agg(F.count(F.lit(1)).alias("n"))

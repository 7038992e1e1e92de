"""C, D, E, F, G, I: filters, joins, aggregates, windows and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import n_distinct_with_null, strict_avg, strict_sum
from ..operators.aggregates import (
    corr_matrix, corr_of_matrix, first_seen, freq_table, group_profile, histogram, histogram_all, line_fit,
    mean_of_sums, six_number, spearman, stack_offsets, triangle,
)
from ..operators.cohort import k_distinct_cohort, observed_in_all
from ..operators.contrasts import pre_post_diff, pre_post_sums
from ..operators.joins import left_join, natural_left_join, restrict_to_cohort, suffix_left_join
from ..operators.ranks import exact_quantiles, null_safe_ntile
from ..operators.reshape import pivot_units, unpivot
from ..operators.spatial import filter_units
from ..operators.windows import entry_exit, first_last_row, follow_up, group_sequence, lag_by, row_slice, running_total
from .frames import EVENT_QUARTERS, POST_QUARTERS, PRE_QUARTERS, UNITS, Tables, sql_on
from .registry import query, settled, settled_sql

# --- C: filters


@query(
    "c1_date_range",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > DATE '1997-06-01' AND o_orderdate <= DATE '1999-06-30'",
)
def date_range(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.filter(
        (d > F.lit("1997-06-01").cast("timestamp_ntz")) & (d <= F.lit("1999-06-30").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_totalprice")


CODES = [f"{k:05d}" for k in (1, 2, 3, 5, 7, 8, 11, 13, 17, 19, 21, 22, 23)]


@query(
    "c2_code_list",
    sql_on("area_orders", body=f"SELECT zip, count(*) AS n FROM area_orders WHERE zip IN {tuple(CODES)} GROUP BY zip"),
)
def code_list(t: Tables):
    return t.area_orders().filter(F.col("zip").isin(CODES)).groupBy("zip").agg(F.count(F.lit(1)).alias("n"))


@query("c3_exclusion", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> 7 AND c_nationkey <> 20")
def exclusion(t: Tables):
    return t.customer.filter(~F.col("c_nationkey").isin(7, 20)).select("c_custkey", "c_nationkey")


@query("c4_equality", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def equality(t: Tables):
    return t.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@query(
    "c5_regex_filter",
    sql_on("exposure", body="""SELECT uid, count(*) AS n, round(sum(exp_qtr), 2) AS total FROM exposure
                               WHERE regexp_matches(uid, 'R|A-F') GROUP BY uid"""),
)
def regex_filter(t: Tables):
    rows = filter_units(t.exposure(), "uid", "R|A-F")
    return rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("exp_qtr"), 2).alias("total"))


@query(
    "c6_complete_cases",
    sql_on("person_days", body="SELECT Date, count(*) AS n FROM person_days WHERE Mold IS NOT NULL AND Rscu IS NOT NULL GROUP BY Date"),
)
def complete_cases(t: Tables):
    return t.person_days().na.drop("any").groupBy("Date").agg(F.count(F.lit(1)).alias("n"))


@query("c7_distinct", "SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def distinct_rows(t: Tables):
    return t.orders.select("o_custkey", F.year("o_orderdate").alias("year")).distinct()


@query(
    "c8_row_slice",
    "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 7 AND 8",
)
def slice_rows(t: Tables):
    return row_slice(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 7, 8)


@query("c9_size", "SELECT count(*) AS n_rows FROM lineitem")
def size(t: Tables):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n_rows"))


# --- D: joins


@query(
    "d1_left_join_same_keys",
    sql_on("exposure", "counts", body="""SELECT e.zip, e.yrq, e.uid, asthma_count FROM exposure e
           LEFT JOIN counts c ON e.zip = c.zip AND e.yrq = c.yrq"""),
)
def same_keys(t: Tables):
    return left_join(t.exposure(), t.counts(), ["zip", "yrq"]).select("zip", "yrq", "uid", "asthma_count")


@query(
    "d2_left_join_other_keys",
    sql_on("wide", "weather", body="""SELECT zip, yrq, round(RH_Quarter, 6) AS RH_Quarter FROM wide
           LEFT JOIN weather ON zip = Zip2010 AND year = Yr AND qtr = qtrSeq"""),
)
def other_keys(t: Tables):
    rows = left_join(t.wide(), t.weather(), {"zip": "Zip2010", "year": "Yr", "qtr": "qtrSeq"})
    return rows.select("zip", "yrq", F.round("RH_Quarter", 6).alias("RH_Quarter"))


@query(
    "d3_natural_left_join",
    """WITH d AS (SELECT o_custkey AS ids, CAST(o_orderdate AS DATE) AS day FROM orders),
            e AS (SELECT ids, min(day) AS entry FROM d GROUP BY ids)
       SELECT d.ids, day, entry FROM d LEFT JOIN e ON d.ids = e.ids""",
)
def natural(t: Tables):
    d = t.orders.select(F.col("o_custkey").alias("ids"), F.col("o_orderdate").cast("date").alias("day"))
    return natural_left_join(d, d.groupBy("ids").agg(F.min("day").alias("entry")))


@query(
    "d3_natural_join_null_keys",
    sql_on("person_days", body="""SELECT a.Mold, n, n_late FROM (SELECT Mold, count(*) AS n FROM person_days GROUP BY Mold) a
           LEFT JOIN (SELECT Mold, count(*) AS n_late FROM person_days WHERE Date > DATE '1998-06-08' GROUP BY Mold) b
           ON a.Mold IS NOT DISTINCT FROM b.Mold"""),
)
def natural_null_keys(t: Tables):
    d = t.person_days()
    a = d.groupBy("Mold").agg(F.count(F.lit(1)).alias("n"))
    b = d.filter(F.col("Date") > "1998-06-08").groupBy("Mold").agg(F.count(F.lit(1)).alias("n_late"))
    return natural_left_join(a, b, nulls_match=True)


@query(
    "d4_cohort_restriction",
    """SELECT c_custkey AS ids, o_orderkey FROM customer c LEFT JOIN orders o
       ON c.c_custkey = o.o_custkey""",
)
def cohort_restriction(t: Tables):
    events = t.orders.select("o_custkey", "o_orderkey")
    return restrict_to_cohort(t.customer.select(F.col("c_custkey").alias("ids")), events, "ids", "o_custkey")


@query(
    "d4_cohort_semi",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def cohort_semi(t: Tables):
    ids = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("ids"))
    return restrict_to_cohort(ids, t.orders.select("o_orderkey", "o_custkey"), "ids", "o_custkey", keep_unmatched=False)


@query(
    "d5_inner_join",
    sql_on("counts", body="SELECT n_name, yrq, asthma_count FROM counts JOIN nation ON zip = lpad(CAST(n_nationkey AS VARCHAR), 5, '0')"),
)
def inner(t: Tables):
    names = t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("zip"), "n_name")
    return t.counts().join(names, "zip").select("n_name", "yrq", "asthma_count")


@query(
    "d7_self_join_to_base",
    sql_on("counts", body="""SELECT a.zip, a.yrq AS yrq_x, b.yrq AS yrq_y, a.asthma_count AS asthma_count_x, b.asthma_count AS asthma_count_y,
           right(a.yrq, 1) AS period FROM counts a LEFT JOIN (SELECT * FROM counts WHERE left(yrq, 4) = '1997') b
           ON a.zip = b.zip AND right(a.yrq, 1) = right(b.yrq, 1)"""),
)
def self_join(t: Tables):
    c = t.counts().withColumn("period", F.substring("yrq", 6, 1))
    return suffix_left_join(c, c.filter(F.col("yrq").startswith("1997")), ["zip", "period"])


# --- E: aggregates


@query(
    "e1_strict_mean",
    sql_on("person_days", body=f"""SELECT uid, {settled_sql('CASE WHEN count(*) = count(Mold) THEN avg(Mold) END', 6)} AS mold,
           {settled_sql('avg(Rscu)', 8)} AS rscu FROM person_days GROUP BY uid"""),
)
def strict_mean(t: Tables):
    return t.person_days().groupBy("uid").agg(
        settled(strict_avg("Mold"), 6).alias("mold"), settled(strict_avg("Rscu"), 8).alias("rscu")
    )


@query("e2_mean_skipping_nulls", sql_on("person_days", body=f"SELECT Date, {settled_sql('avg(Mold)', 6)} AS mold FROM person_days GROUP BY Date"))
def lenient_mean(t: Tables):
    return t.person_days().groupBy("Date").agg(settled(F.avg("Mold"), 6).alias("mold"))


@query(
    "e3_strict_sum",
    sql_on("person_days", body="SELECT uid, CASE WHEN count(*) = count(Mold) THEN sum(Mold) END AS mold FROM person_days GROUP BY uid"),
)
def strict_total(t: Tables):
    return t.person_days().groupBy("uid").agg(strict_sum("Mold").alias("mold"))


@query(
    "e4_distinct_count",
    sql_on("person_days", body="""SELECT uid, count(DISTINCT Mold) + max(CASE WHEN Mold IS NULL THEN 1 ELSE 0 END) AS n_mold,
           count(DISTINCT Date) AS n_days FROM person_days GROUP BY uid"""),
)
def distinct_counts(t: Tables):
    return t.person_days().groupBy("uid").agg(n_distinct_with_null("Mold").alias("n_mold"), F.countDistinct("Date").alias("n_days"))


_SIDES = """SELECT o_custkey AS uid, CASE WHEN d > -365 AND d <= 0 THEN 1 WHEN d > 0 AND d < 365 THEN 2 ELSE 0 END AS side
            FROM (SELECT o_custkey, date_diff('day', DATE '1998-06-08', CAST(o_orderdate AS DATE)) AS d FROM orders)"""


def _sides(t: Tables):
    from ..functions.dates import event_window

    return t.orders.select(F.col("o_custkey").alias("uid"), event_window(F.col("o_orderdate").cast("date"), "1998-06-08", 365, 365).alias("side"))


@query("e5_k_distinct_cohort", f"SELECT uid FROM ({_SIDES}) GROUP BY uid HAVING count(DISTINCT side) = 2")
def cohort_literal(t: Tables):
    return k_distinct_cohort(_sides(t), "uid", "side", 2)


@query(
    "e5_observed_in_all",
    f"SELECT uid FROM ({_SIDES}) GROUP BY uid HAVING max(CASE WHEN side = 1 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN side = 2 THEN 1 ELSE 0 END) = 1",
)
def cohort_intended(t: Tables):
    return observed_in_all(_sides(t), "uid", "side", [1, 2])


@query(
    "e6_group_profile",
    f"""SELECT o_custkey, {settled_sql('avg(o_totalprice)', 4)} AS mean, round(sum(o_totalprice), 2) AS sum,
       {settled_sql('quantile_cont(o_totalprice, 0.25)', 4)} AS q1, {settled_sql('quantile_cont(o_totalprice, 0.75)', 4)} AS q3 FROM orders GROUP BY o_custkey""",
)
def profile(t: Tables):
    p = group_profile(t.orders, ["o_custkey"], "o_totalprice")
    return p.select("o_custkey", settled("mean", 4).alias("mean"), F.round("sum", 2).alias("sum"), settled("q1", 4).alias("q1"), settled("q3", 4).alias("q3"))


_DECILES = [i / 10 for i in range(1, 11)]


@query(
    "e7_global_quantiles",
    "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS q{round(100 * p)}" for p in _DECILES) + " FROM lineitem",
)
def deciles(t: Tables):
    q = exact_quantiles(t.lineitem, "l_extendedprice", _DECILES)
    return q.select(*[F.round(c, 4).alias(c) for c in q.columns])


@query("e8_freq_table", sql_on("person_days", body="SELECT Mold, count(*) AS n FROM person_days WHERE Mold IS NOT NULL GROUP BY Mold"))
def frequencies(t: Tables):
    return freq_table(t.person_days(), "Mold")


@query(
    "e9_six_number",
    sql_on("person_days", body="""SELECT min(Mold) AS min, quantile_cont(Mold, 0.25) AS q1, quantile_cont(Mold, 0.5) AS median,
           round(avg(Mold), 8) AS mean, quantile_cont(Mold, 0.75) AS q3, max(Mold) AS max, count(*) - count(Mold) AS n_null FROM person_days"""),
)
def six_numbers(t: Tables):
    return six_number(t.person_days(), "Mold").withColumn("mean", F.round("mean", 8))


@query("e10_column_total", sql_on("demographics", body="SELECT CAST(sum(totpop) AS BIGINT) AS total FROM demographics"))
def column_total(t: Tables):
    return t.demographics().agg(F.sum("totpop").alias("total"))


@query("e11_column_max", sql_on("monthly", body="SELECT max(month) AS last_month, max(quarter) AS last_quarter FROM monthly"))
def column_max(t: Tables):
    return t.monthly().agg(F.max("month").alias("last_month"), F.max("quarter").alias("last_quarter"))


@query(
    "e12_mean_of_sums",
    sql_on("monthly", body=f"""SELECT uID, date_month, {settled_sql('avg(v)', 4)} AS hyads FROM
           (SELECT ZIP, uID, date_month, sum(exposure) AS v FROM monthly GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
)
def two_stage(t: Tables):
    m = mean_of_sums(t.monthly(), ["ZIP", "uID", "date_month"], ["uID", "date_month"], "exposure", "hyads")
    return m.withColumn("hyads", settled("hyads", 4))


def _hist_sql(table: str, col: str, bins: int) -> str:
    return f"""SELECT bin, lo + (bin - 1) * (hi - lo) / {bins - 1} AS center, count(*) AS n FROM (
        SELECT lo, hi, CAST(greatest(least(ceil((x - lo) / ((hi - lo) / {bins - 1}) + 0.5), {bins}), 1) AS INTEGER) AS bin
        FROM (SELECT {col} AS x FROM {table} WHERE {col} IS NOT NULL), (SELECT min({col}) AS lo, max({col}) AS hi FROM {table}))
        GROUP BY bin, lo, hi"""


@query("e13_histogram", f"SELECT bin, round(center, 6) AS center, n FROM ({_hist_sql('orders', 'o_totalprice', 50)})")
def hist(t: Tables):
    return histogram(t.orders, "o_totalprice", 50).withColumn("center", F.round("center", 6))


_HIST_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "e13_histogram_all_columns",
    " UNION ALL ".join(f"SELECT '{c}' AS key, bin, round(center, 6) AS center, n FROM ({_hist_sql('lineitem', c, 10)})" for c in _HIST_COLS),
)
def hist_all(t: Tables):
    return histogram_all(t.lineitem, _HIST_COLS, 10).withColumn("center", F.round("center", 6))


def _rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "e14_spearman",
    f"SELECT round(corr(a, b), 8) AS rho FROM (SELECT {_rank_sql('l_quantity')} AS a, {_rank_sql('l_extendedprice')} AS b FROM lineitem)",
)
def rank_correlation(t: Tables):
    return spearman(t.lineitem, "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 8))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_cells(rank: bool, digits: int) -> str:
    inner = ", ".join((_rank_sql(c) if rank else c) + f" AS {c}" for c in _CORR)
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, {i} AS i, {j} AS j, round(corr({a}, {b}), {digits}) AS value FROM r"
        for i, a in enumerate(_CORR) for j, b in enumerate(_CORR)
    )
    return f"WITH r AS MATERIALIZED (SELECT {inner} FROM lineitem), cells AS ({cells}) "


@query("e15_corr_matrix", _corr_cells(True, 4) + "SELECT * FROM cells")
def correlations(t: Tables):
    return corr_matrix(t.lineitem, _CORR, "spearman", 4)


@query(
    "e15_corr_of_matrix",
    _corr_cells(False, 6) + "SELECT a.var2 AS var1, b.var2 AS var2, round(corr(a.value, b.value), 3) AS value FROM cells a JOIN cells b ON a.var1 = b.var1 GROUP BY 1, 2",
)
def correlation_of_correlations(t: Tables):
    m = corr_matrix(t.lineitem, _CORR, "pearson", 6)
    return corr_of_matrix(m).withColumn("value", F.round("value", 3))


@query(
    "e16_line_fit",
    "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem",
)
def scatter_line(t: Tables):
    f = line_fit(t.lineitem, "l_quantity", "l_extendedprice")
    return f.select(F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"))


@query("e17_first_seen", "SELECT o_orderpriority, min(o_orderkey) AS first_seen FROM orders GROUP BY 1")
def unique_in_order(t: Tables):
    return first_seen(t.orders, "o_orderpriority", "o_orderkey")


# --- F, G: windows and sorts


@query("f1_group_sequence", sql_on("counts", body="SELECT zip, yrq, CAST(row_number() OVER (PARTITION BY zip ORDER BY yrq) AS INTEGER) AS time FROM counts"))
def sequence(t: Tables):
    return group_sequence(t.counts(), "zip", "yrq").select("zip", "yrq", "time")


@query("f2_running_total", sql_on("person_months", body="SELECT uid, t, count(*) OVER (PARTITION BY uid ORDER BY t) AS time FROM person_months"))
def cumulative(t: Tables):
    m = t.person_months().select("uid", "t").withColumn("number", F.lit(1))
    return running_total(m, "uid", "t", "number", "time").select("uid", "t", "time")


@query(
    "f3_null_safe_ntile",
    sql_on("person_days", body="""SELECT Mold, tile, count(*) AS n FROM (SELECT Mold, CAST(ntile(10) OVER (ORDER BY Mold, uid, Date, Rscu) AS INTEGER) AS tile
           FROM person_days WHERE Mold IS NOT NULL UNION ALL SELECT Mold, NULL FROM person_days WHERE Mold IS NULL) GROUP BY 1, 2"""),
)
def tiles(t: Tables):
    d = null_safe_ntile(t.person_days(), "Mold", 10, ["uid", "Date", "Rscu"], "tile")
    return d.groupBy("Mold", "tile").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f4_lag_by_person",
    sql_on("person_months", body=f"SELECT uid, t, {settled_sql('lag(Rscu) OVER (PARTITION BY uid ORDER BY t)', 8)} AS prev FROM person_months"),
)
def lagged(t: Tables):
    return lag_by(t.person_months(), "uid", "t", "Rscu", "prev").select("uid", "t", settled("prev", 8).alias("prev"))


@query(
    "f4_lag_across_persons",
    sql_on("person_months", body=f"SELECT uid, t, {settled_sql('lag(Rscu) OVER (ORDER BY uid, t)', 8)} AS prev FROM person_months"),
)
def lagged_literal(t: Tables):
    d = lag_by(t.person_months().select("uid", "t", "Rscu"), "uid", "t", "Rscu", "prev", across=True)
    return d.select("uid", "t", settled("prev", 8).alias("prev"))


@query("f5_entry_exit", sql_on("person_days", body="SELECT uid, min(Date) AS entry, max(Date) AS exit FROM person_days GROUP BY uid"))
def spans(t: Tables):
    return entry_exit(t.person_days(), "uid", "Date")


@query(
    "f6_follow_up",
    sql_on("person_days", body="""SELECT d.uid, Date, Rscu, entry, exit, CAST(year(entry) AS INTEGER) AS entry_yr,
           CAST(date_diff('day', entry, exit) AS INTEGER) AS duration FROM person_days d
           JOIN (SELECT uid, min(Date) AS entry, max(Date) AS exit FROM person_days GROUP BY uid) e ON d.uid = e.uid"""),
)
def follow(t: Tables):
    return follow_up(t.person_days().select("uid", "Date", "Rscu"), "uid", "Date")


@query(
    "f7_stack_offsets",
    sql_on("exposure", body="""SELECT yrq, uid, round(v, 2) AS v, round(sum(v) OVER (PARTITION BY yrq ORDER BY uid), 2) AS ymax,
           round(sum(v) OVER (PARTITION BY yrq ORDER BY uid) - v, 2) AS ymin
           FROM (SELECT yrq, uid, sum(exp_qtr) AS v FROM exposure GROUP BY 1, 2)"""),
)
def stacked(t: Tables):
    s = stack_offsets(t.exposure().groupBy("yrq", "uid").agg(F.sum("exp_qtr").alias("v")), "yrq", "uid", "v")
    return s.select("yrq", "uid", *[F.round(c, 2).alias(c) for c in ("v", "ymax", "ymin")])


@query("g1_sort", sql_on("person_days", body="SELECT uid, Date, Mold FROM person_days ORDER BY Mold NULLS LAST, Date, uid"))
def sorted_rows(t: Tables):
    return t.person_days().select("uid", "Date", "Mold").orderBy(F.col("Mold").asc_nulls_last(), "Date", "uid")


@query(
    "g2_first_and_last_row",
    """SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1""",
)
def edge_rows(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("first_price"))
    first = first_last_row(o, "o_custkey", "o_orderkey").select("o_custkey", "first_price")
    last = first_last_row(o.withColumnRenamed("first_price", "last_price"), "o_custkey", "o_orderkey", last=True)
    return first.join(last.select("o_custkey", "last_price"), "o_custkey")


# --- I: reshapes


@query("i1_pivot_units", sql_on("wide", body="SELECT zip, yrq, " + ", ".join(f"round(plant_{u.replace('-', '_')}, 2) AS plant_{u.replace('-', '_')}" for u in UNITS) + " FROM wide"))
def pivoted(t: Tables):
    w = t.wide()
    return w.select("zip", "yrq", *[F.round(c, 2).alias(c) for c in w.columns if c.startswith("plant_")])


@query(
    "i2_two_level_pivot",
    """SELECT o_custkey, max(CASE WHEN late = 0 THEN s END) AS early, max(CASE WHEN late = 1 THEN s END) AS late FROM
       (SELECT o_custkey, CASE WHEN o_orderdate >= DATE '1998-06-08' THEN 1 ELSE 0 END AS late, round(sum(o_totalprice), 2) AS s
        FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def two_level(t: Tables):
    late = (F.col("o_orderdate") >= F.lit("1998-06-08").cast("timestamp_ntz")).cast("int")
    sums = t.orders.groupBy("o_custkey", late.alias("late")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    return pivot_units(sums, ["o_custkey"], "late", "s", [0, 1], ["early", "late"])


_MEASURES = {
    "hyads_diff": "hyads_tot", "asthma_diff": "asthma_count", "totpop_diff": "totpop", "uninsur_diff": "uninsur_p",
    "black_diff": "black_p", "pov_diff": "pov_p", "RH_diff": "RH_Quarter", "Pres_diff": "Pres_Quarter", "WS_diff": "WS_Quarter",
    "Temp_diff": "Temp_Quarter",
}


def strict_when(flag: str, c: str) -> str:
    return f"CASE WHEN count(CASE WHEN {flag} THEN 1 END) = count(CASE WHEN {flag} THEN {c} END) THEN sum(CASE WHEN {flag} THEN {c} END) END"


PRE_SQL, POST_SQL = f"yrq IN {tuple(PRE_QUARTERS)}", f"yrq IN {tuple(POST_QUARTERS)}"


@query(
    "i3_pre_post_diff",
    sql_on("panel", body="SELECT zip, " + ", ".join(
        f"round(CAST({strict_when(POST_SQL, c)} - {strict_when(PRE_SQL, c)} AS DOUBLE), 4) AS {n}" for n, c in _MEASURES.items()) + " FROM panel GROUP BY zip"),
)
def pre_post(t: Tables):
    d = pre_post_differences(t)
    return d.select("zip", *[F.round(c, 4).alias(c) for c in _MEASURES])


def pre_post_differences(t: Tables):
    panel = t.panel()
    return pre_post_diff(panel, ["zip"], F.col("yrq").isin(PRE_QUARTERS), F.col("yrq").isin(POST_QUARTERS), {
        n: c for n, c in _MEASURES.items()
    }).withColumn("asthma_diff", F.col("asthma_diff").cast("double")).withColumn("totpop_diff", F.col("totpop_diff").cast("double"))


@query(
    "i3_pre_post_sums",
    sql_on("exposure", body=f"""SELECT zip, uid, round(sum(CASE WHEN {PRE_SQL} THEN exp_qtr END), 2) AS exp_pre,
           round(sum(CASE WHEN {POST_SQL} THEN exp_qtr END), 2) AS exp_post FROM exposure WHERE yrq IN {tuple(EVENT_QUARTERS)} GROUP BY 1, 2"""),
)
def pre_post_totals(t: Tables):
    rows = t.exposure().filter(F.col("yrq").isin(EVENT_QUARTERS))
    s = pre_post_sums(rows, ["zip", "uid"], F.col("yrq").isin(PRE_QUARTERS), F.col("yrq").isin(POST_QUARTERS), {"exp": "exp_qtr"})
    return s.select("zip", "uid", F.round("exp_pre", 2).alias("exp_pre"), F.round("exp_post", 2).alias("exp_post"))


@query(
    "i4_unpivot",
    "SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) "
    "UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))",
)
def melted(t: Tables):
    return unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("i5_matrix_triangle", _corr_cells(True, 2) + "SELECT * FROM cells WHERE i <= j")
def upper_triangle(t: Tables):
    return triangle(corr_matrix(t.lineitem, _CORR, "spearman", 2))

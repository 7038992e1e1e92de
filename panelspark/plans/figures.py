"""Tables behind the figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import relabel, row_total
from ..functions.nulls import strict_avg, strict_sum
from ..functions.text import pad_code
from ..models import Factor, Harmonic, fe_poisson, predict_by
from ..operators.aggregates import corr_matrix, mean_of_sums, period_apply, stack_offsets, triangle
from ..operators.joins import left_join
from ..operators.ranks import exact_quantiles, null_safe_ntile
from ..operators.reshape import unpivot
from ..operators.windows import row_slice
from ..session import handed_over, scratch_path
from ..sources.tables import period_dim, read_delimited, write_delimited
from .frames import EXPOSURE_UNITS, Tables, exposure_groups_of, sql_on
from .registry import query, settled, settled_sql
from .relations import CODES, POST_SQL, PRE_SQL, pre_post_differences, strict_when

_PANEL = ("zip", "yrq", "asthma_count", "tot_exp", "hyads_tot", "totpop")


@query(
    "q4_parallel_trends",
    sql_on(
        "panel", "groups",
        body="""
        SELECT exposed, yrq, round(avg(asthma_count), 6) AS mean_asthma
        FROM panel p JOIN groups g ON p.zip = g.zip
        WHERE exposed IS NOT NULL AND asthma_count IS NOT NULL AND tot_exp IS NOT NULL AND hyads_tot IS NOT NULL
          AND totpop IS NOT NULL
        GROUP BY exposed, yrq""",
    ),
)
def parallel_trends(t: Tables):
    panel = handed_over(t.panel().select(*_PANEL), "trend-rows")  # line items and orders are joined once
    rows = left_join(panel, exposure_groups_of(panel), ["zip"]).na.drop("any")
    return rows.groupBy("exposed", "yrq").agg(F.round(strict_avg("asthma_count"), 6).alias("mean_asthma"))


@query(
    "q1_city_total",
    sql_on("panel", body="""SELECT yrq, CAST(sum(asthma_count) AS BIGINT) AS sum_asthma FROM panel WHERE asthma_count IS NOT NULL AND tot_exp IS NOT NULL
           AND totpop IS NOT NULL AND hyads_tot IS NOT NULL GROUP BY yrq"""),
)
def city_total(t: Tables):
    panel = t.panel().select("yrq", "asthma_count", "tot_exp", "totpop", "hyads_tot").na.drop("any")
    return panel.groupBy("yrq").agg(strict_sum("asthma_count").alias("sum_asthma"))


@query(
    "q2_map_with_counts",
    sql_on("counts", body=f"""SELECT n.zip, n_name, yrq, asthma_count FROM (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS zip, n_name FROM nation) n
           LEFT JOIN counts c ON n.zip = c.zip WHERE n.zip IN {tuple(CODES)}"""),
)
def map_counts(t: Tables):
    areas = t.nation.select(pad_code("n_nationkey").alias("zip"), "n_name").filter(F.col("zip").isin(CODES))
    return left_join(areas, t.counts(), ["zip"])


@query(
    "q3_exposure_deciles",
    sql_on("panel", body="""SELECT zip, yrq, CAST(ntile(10) OVER (ORDER BY tot_exp, zip, yrq) AS INTEGER) AS tot_exp10 FROM panel WHERE tot_exp IS NOT NULL
           UNION ALL SELECT zip, yrq, NULL FROM panel WHERE tot_exp IS NULL"""),
)
def exposure_deciles(t: Tables):
    wide = row_total(t.wide(), "tot_exp", EXPOSURE_UNITS).select("zip", "yrq", "tot_exp")
    return null_safe_ntile(wide, "tot_exp", 10, ["zip", "yrq"], "tot_exp10").select("zip", "yrq", "tot_exp10")


@query(
    "q3_decile_cuts",
    sql_on("panel", body="SELECT " + ", ".join(f"round(quantile_cont(tot_exp, {i / 10}), 4) AS q{i * 10}" for i in range(1, 11)) + " FROM panel"),
)
def decile_cuts(t: Tables):
    wide = handed_over(row_total(t.wide(), "tot_exp", EXPOSURE_UNITS).select("tot_exp"), "decile-rows")
    q = exact_quantiles(wide, "tot_exp", [i / 10 for i in range(1, 11)])
    return q.select(*[F.round(c, 4).alias(c) for c in q.columns])


@query(
    "q5_unit_quarter_series",
    sql_on("monthly", body=f"""SELECT uID, quarter, year, make_date(year, quarter * 3 - 2, 1) AS date, {settled_sql('v', 4)} AS value,
           {settled_sql('sum(v) OVER (PARTITION BY year, quarter ORDER BY uID)', 4)} AS ymax
           FROM (SELECT uID, quarter, year, avg(exposure) AS v FROM monthly WHERE year BETWEEN 1995 AND 2001 GROUP BY 1, 2, 3)"""),
)
def unit_quarters(t: Tables):
    means = t.monthly().groupBy("uID", "quarter", "year").agg(strict_avg("exposure").alias("v"))
    dim = period_dim(t.spark, "1995-01-01", "2001-10-01", "quarter").select("date", "year", "quarter")
    s = stack_offsets(means.join(dim, ["quarter", "year"]), "date", "uID", "v")
    return s.select("uID", "quarter", "year", "date", settled("v", 4).alias("value"), settled("ymax", 4).alias("ymax"))


@query(
    "q6_unit_month_series",
    sql_on("monthly", body=f"""SELECT uID, variable, date_month, quarter, {settled_sql('avg(v)', 4)} AS hyads FROM
           (SELECT ZIP, uID, 'exposure' AS variable, date_month, quarter, sum(exposure) AS v FROM monthly GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4"""),
)
def unit_months(t: Tables):
    long = unpivot(t.monthly(), ["ZIP", "date_month", "year", "month", "uID", "quarter"], ["exposure"])
    keys = ["uID", "variable", "date_month", "quarter"]
    return mean_of_sums(long, ["ZIP", *keys], keys, "value", "hyads").withColumn("hyads", settled("hyads", 4))


@query(
    "q8_mean_daily_use",
    sql_on("person_days", body=f"""SELECT Date, {settled_sql('avg(Rscu)', 8)} AS rscu FROM person_days
           WHERE Date > DATE '1997-06-01' AND Date <= DATE '1999-06-30' GROUP BY Date"""),
)
def daily_use(t: Tables):
    d = F.col("Date")
    rows = t.person_days().filter((d > F.lit("1997-06-01").cast("date")) & (d <= F.lit("1999-06-30").cast("date")))
    return rows.groupBy("Date").agg(settled(F.avg("Rscu"), 8).alias("rscu"))


@query(
    "q9_predicted_by_year",
    sql_on("person_months", body="""SELECT CAST(year(period) AS INTEGER) AS year, CASE WHEN year(period) < 1998 THEN 'Pre' ELSE 'Post' END AS switch,
           round(avg(Rscu_sum), 6) AS mean_rscu FROM person_months GROUP BY 1, 2"""),
)
def predicted_by_year(t: Tables):
    # With one dummy a year the predicted mean of a year is the observed one, whatever the persons' effects.
    months = t.person_months().withColumn("year", F.year("period"))
    fit = fe_poisson(months, "Rscu_sum", [Factor("year")], absorb="uid")
    means = handed_over(predict_by(fit, ["year"]), "predicted-means")
    fit.release()
    switch = F.when(F.col("year") < 1998, "Pre").otherwise("Post")
    return means.select("year", switch.alias("switch"), F.round("mean_predicted", 6).alias("mean_rscu"))


@query("q9_predicted_means")
def predicted_means(t: Tables):
    fit = fe_poisson(t.person_months(), "Rscu_sum", ["scrub4", "t", "t_scrub4", Harmonic("month", 2, 12)], absorb="uid")
    means = handed_over(predict_by(fit, ["t"]), "predicted-means")
    fit.release()
    switch = F.when(F.col("t") < 42, "Pre").when(F.col("t") >= 42, "Post")
    return means.select("t", switch.alias("switch"), F.round("mean_predicted", 6).alias("mean_rscu"))


@query(
    "q10_correlation_cells",
    sql_on("panel", extra={
        "d": f"""SELECT {strict_when(POST_SQL, 'hyads_tot')} - {strict_when(PRE_SQL, 'hyads_tot')} AS hyads_diff,
                 {strict_when(POST_SQL, 'asthma_count')} - {strict_when(PRE_SQL, 'asthma_count')} AS asthma_diff,
                 {strict_when(POST_SQL, 'RH_Quarter')} - {strict_when(PRE_SQL, 'RH_Quarter')} AS RH_diff FROM panel GROUP BY zip""",
        "k": "SELECT * FROM d WHERE hyads_diff IS NOT NULL AND asthma_diff IS NOT NULL AND RH_diff IS NOT NULL",
        "r": "SELECT " + ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("hyads_diff", "asthma_diff", "RH_diff")
        ) + " FROM k",
    }, body="SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 2) AS value FROM r"
        for i, a in enumerate(("hyads_diff", "asthma_diff", "RH_diff")) for b in ("hyads_diff", "asthma_diff", "RH_diff")[i:]
    ) + ") WHERE value IS NOT NULL"),
)
def heat_map_cells(t: Tables):
    d = pre_post_differences(t).select("hyads_diff", "asthma_diff", "RH_diff")
    return triangle(corr_matrix(d, d.columns, "spearman", 2)).select("var1", "var2", "value")


@query(
    "q11_pooled_month_lines",
    sql_on("person_days", body=f"""SELECT CAST(date_trunc('month', Date) AS DATE) AS period, max(Date) AS date_last, {settled_sql('avg(Rscu)', 8)} AS rscu
           FROM person_days WHERE Date > DATE '1997-01-01' GROUP BY 1"""),
)
def pooled_lines(t: Tables):
    rows = t.person_days().filter(F.col("Date") > F.lit("1997-01-01").cast("date"))
    return period_apply(rows, [], "Date", "month", {"rscu": settled(strict_avg("Rscu"), 8)})


@query(
    "q11_unit_month_lines",
    f"""SELECT l_returnflag || '-' || l_linestatus AS uid, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, max(CAST(l_shipdate AS DATE)) AS date_last,
       {settled_sql('avg(l_extendedprice)', 4)} AS hyads FROM lineitem WHERE l_shipdate > DATE '1997-05-01' AND l_shipdate < DATE '1999-07-01' GROUP BY 1, 2""",
)
def unit_lines(t: Tables):
    d = F.col("l_shipdate")
    rows = t.lineitem.filter((d > F.lit("1997-05-01").cast("timestamp_ntz")) & (d < F.lit("1999-07-01").cast("timestamp_ntz")))
    rows = rows.withColumn("uid", F.concat_ws("-", "l_returnflag", "l_linestatus"))
    return period_apply(rows, ["uid"], "l_shipdate", "month", {"hyads": settled(strict_avg("l_extendedprice"), 4)})


@query(
    "q12_estimate_rows",
    f"""SELECT 'p' || substr(o_orderpriority, 1, 1) AS grp, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' END AS grp_f,
       {settled_sql("avg(o_totalprice)", 4)} AS p FROM orders WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM') GROUP BY o_orderpriority""",
)
def estimate_rows(t: Tables):
    # Rows two and three of the estimate table in its own order.
    est = t.orders.groupBy("o_orderpriority").agg(settled(F.avg("o_totalprice"), 4).alias("p"))
    path = write_delimited(est, scratch_path(t.spark, "estimates-csv"))
    back = read_delimited(t.spark, path, est.schema)
    picked = row_slice(back, "o_orderpriority", 2, 3)
    picked = relabel(picked, "o_orderpriority", ["1-URGENT", "2-HIGH"], ["Urgent", "High"], into="grp_f")
    return picked.select(F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("grp"), "grp_f", "p")

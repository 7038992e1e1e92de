"""M: regressions on the area-quarter and person-month panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cut_points, interaction, share_of_total
from ..models import (
    Factor, Harmonic, Spline, cluster_se, deviance_residuals, fe_logit, fe_poisson, inverse_link, lagged_residual,
    ols, poisson_glm, predict, predict_by, vif, wls,
)
from ..operators.joins import left_join
from ..session import handed_over
from .frames import STEPS, WEATHER, Tables, sql_on
from .registry import query

# Saturated two-by-two model in closed form: cell means, pooled within-cell variance.
DID_SQL = sql_on(
    "event_panel",
    body="SELECT term, round(estimate, 5) AS estimate, round(se, 5) AS se FROM did",
    extra={
        "cells": "SELECT exposed, coalclose, avg(asthma_count) AS m, count(*) AS n, var_pop(asthma_count) * count(*) AS ss "
                 "FROM event_panel WHERE exposed IS NOT NULL GROUP BY exposed, coalclose",
        "c": "SELECT max(CASE WHEN exposed = 0 AND coalclose = 0 THEN m END) AS m00, max(CASE WHEN exposed = 0 AND coalclose = 1 THEN m END) AS m01, "
             "max(CASE WHEN exposed = 1 AND coalclose = 0 THEN m END) AS m10, max(CASE WHEN exposed = 1 AND coalclose = 1 THEN m END) AS m11, "
             "max(CASE WHEN exposed = 0 AND coalclose = 0 THEN 1.0 / n END) AS v00, max(CASE WHEN exposed = 0 AND coalclose = 1 THEN 1.0 / n END) AS v01, "
             "max(CASE WHEN exposed = 1 AND coalclose = 0 THEN 1.0 / n END) AS v10, max(CASE WHEN exposed = 1 AND coalclose = 1 THEN 1.0 / n END) AS v11, "
             "sum(ss) / (sum(n) - 4) AS s2 FROM cells",
        "did": "SELECT '(Intercept)' AS term, m00 AS estimate, sqrt(s2 * v00) AS se FROM c "
               "UNION ALL SELECT 'coalclose', m01 - m00, sqrt(s2 * (v00 + v01)) FROM c "
               "UNION ALL SELECT 'exposed', m10 - m00, sqrt(s2 * (v00 + v10)) FROM c "
               "UNION ALL SELECT 'exposed_coalclose', (m11 - m10) - (m01 - m00), sqrt(s2 * (v00 + v01 + v10 + v11)) FROM c",
    },
)


def _est(table, digits: int = 5):
    return table.select("term", F.round("estimate", digits).alias("estimate"), F.round("se", digits).alias("se"))


@query("m1_did_saturated", DID_SQL)
def did(t: Tables):
    fit = ols(t.event_panel(), "asthma_count", ["coalclose", "exposed", "exposed_coalclose"])
    out = _est(fit.table())
    fit.release()
    return out


@query(
    "m1_within_slope",
    sql_on("panel", body="""SELECT 'tot_exp' AS term, round(regr_slope(y, x) * 100000, 6) AS estimate FROM
           (SELECT asthma_count - avg(asthma_count) OVER (PARTITION BY zip) AS y, tot_exp - avg(tot_exp) OVER (PARTITION BY zip) AS x
            FROM panel WHERE tot_exp IS NOT NULL)"""),
)
def within(t: Tables):
    fit = ols(t.panel(), "asthma_count", ["tot_exp"], absorb="zip")
    out = fit.table().select("term", F.round(F.col("estimate") * 100000, 6).alias("estimate"))
    fit.release()
    return out


@query("m1_exposure_on_events")
def event_steps(t: Tables):
    terms = [*STEPS, Factor("qtr", base=2), Factor("zip", base="00016"), *WEATHER]
    fit = ols(t.panel().withColumn("tot_exp", F.col("tot_exp") / 1000), "tot_exp", terms)
    out = _est(fit.table(["(Intercept)", *STEPS]))
    fit.release()
    return out


@query("m1_did_adjusted")
def did_adjusted(t: Tables):
    terms = ["coalclose", "exposed", "exposed_coalclose", "totpop", "uninsur_p", Factor("qtr", base=2), Factor("year"),
             "pov_p", "black_p", *WEATHER, Factor("zip")]
    fit = ols(t.event_panel(), "asthma_count", terms)
    out = _est(fit.table())
    fit.release()
    return out


_W_SLOPE = """SELECT 'pre_hyads' AS term, round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)), 6) AS estimate FROM
    (SELECT pre_hyads AS x, asthma_count AS y, totpop AS w FROM event_panel WHERE pre_hyads IS NOT NULL AND totpop IS NOT NULL),
    (SELECT sum(totpop * pre_hyads) / sum(totpop) AS mx, sum(totpop * asthma_count) / sum(totpop) AS my
     FROM event_panel WHERE pre_hyads IS NOT NULL AND totpop IS NOT NULL)"""


@query("m2_weighted_slope", sql_on("event_panel", body=_W_SLOPE))
def weighted(t: Tables):
    panel = share_of_total(t.event_panel(), "totpop", "wts")
    fit = wls(panel, "asthma_count", ["pre_hyads"], weights="wts")
    out = fit.table(["pre_hyads"]).select("term", F.round("estimate", 6).alias("estimate"))
    fit.release()
    return out


@query("m2_weighted_did")
def weighted_did(t: Tables):
    panel = share_of_total(t.event_panel(), "totpop", "wts")
    fit = wls(panel, "asthma_count", ["coalclose", "exposed", "exposed_coalclose", Factor("zip")], weights="wts")
    out = _est(fit.table(["(Intercept)", "coalclose", "exposed", "exposed_coalclose"]))
    fit.release()
    return out


_RATES = """SELECT exposed, sum(asthma_count) AS y, sum(totpop) AS pop FROM event_panel WHERE exposed IS NOT NULL AND totpop IS NOT NULL GROUP BY exposed"""


@query(
    "m3_poisson_rates",
    sql_on("event_panel", extra={"r": _RATES}, body="""
        SELECT '(Intercept)' AS term, round(ln(y / pop), 7) AS estimate FROM r WHERE exposed = 0 UNION ALL
        SELECT 'exposed', round(ln(a.y / a.pop) - ln(b.y / b.pop), 7) FROM r a, r b WHERE a.exposed = 1 AND b.exposed = 0"""),
)
def poisson_rates(t: Tables):
    fit = poisson_glm(t.event_panel().withColumn("log_pop", F.log("totpop")), "asthma_count", ["exposed"], offset="log_pop")
    out = fit.table().select("term", F.round("estimate", 7).alias("estimate"))
    fit.release()
    return out


def _count_model(t: Tables):
    panel = t.panel().withColumn("log_pop", F.log("totpop"))
    terms = [*STEPS, Factor("qtr", base=2), "uninsur_p", "pov_p", "black_p", *WEATHER]
    return fe_poisson(panel, "asthma_count", terms, absorb="zip", offset="log_pop")


@query("m3_poisson_area_effects")
def poisson_areas(t: Tables):
    fit = _count_model(t)
    out = _est(fit.table(list(STEPS)))
    fit.release()
    return out


def _grid(t: Tables, first: int, last: int):
    """(area, y, n, total, region): orders per area and year, every cell once, empty ones as zero."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("area"), F.year("o_orderdate").alias("y"), "o_totalprice")
    sums = joined.filter(f"y between {first} and {last}").groupBy("area", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    grid = t.nation.select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("region"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("y"))
    return grid.join(sums, ["area", "y"], "left").na.fill({"n": 0, "total": 0.0})


_GRID = """SELECT n_nationkey AS area, n_regionkey AS region, g.y, coalesce(n, 0) AS n, coalesce(total, 0) AS total
    FROM nation CROSS JOIN (SELECT unnest(generate_series({0}, {1})) AS y) g LEFT JOIN
    (SELECT c_nationkey, year(o_orderdate) AS y, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) s
    ON c_nationkey = n_nationkey AND s.y = g.y"""


@query(
    "m1_two_way_slope",
    f"""WITH g AS ({_GRID.format(1993, 1997)}),
    d AS (SELECT n - avg(n) OVER (PARTITION BY area) - avg(n) OVER (PARTITION BY y) + avg(n) OVER () AS v,
          total / 1e6 - avg(total / 1e6) OVER (PARTITION BY area) - avg(total / 1e6) OVER (PARTITION BY y) + avg(total / 1e6) OVER () AS x FROM g)
    SELECT 'millions' AS term, round(sum(x * v) / sum(x * x), 5) AS estimate, round(sqrt((sum(v * v) - sum(x * v) * sum(x * v) / sum(x * x))
           / (count(*) - 1 - (25 + 5 - 1)) / sum(x * x)), 5) AS se FROM d""",
)
def two_way(t: Tables):
    fit = ols(_grid(t, 1993, 1997).withColumn("millions", F.col("total") / 1e6), "n", ["millions"], absorb=("area", "y"))
    out = _est(fit.table())
    fit.release()
    return out


@query(
    "m3_two_way_step",
    f"""WITH g AS ({_GRID.format(1994, 1997)}), s AS (SELECT sum(n) FILTER (region < 2 AND y < 1996) AS a, sum(n) FILTER (region < 2 AND y >= 1996) AS b,
    sum(n) FILTER (region >= 2 AND y < 1996) AS c, sum(n) FILTER (region >= 2 AND y >= 1996) AS d FROM g)
    SELECT 'step' AS term, round(ln(d * a / (b * c)), 5) AS estimate FROM s""",
)
def two_way_step(t: Tables):
    """With area and year effects, a step of some areas from one year on is the log odds ratio of the pooled counts."""
    rows = _grid(t, 1994, 1997).withColumn("step", ((F.col("region") >= 2) & (F.col("y") >= 1996)).cast("double"))
    fit = fe_poisson(rows, "n", ["step"], absorb=("area", "y"))
    out = fit.table().select("term", F.round("estimate", 5).alias("estimate"))
    fit.release()
    return out


def _its_terms():
    return ["scrub4", "t", "t_scrub4", Harmonic("month", 2, 12), Spline("RelativeHumidity", 2), "WindSpeed"]


@query("m4_fixed_effect_poisson")
def person_poisson(t: Tables):
    fit = fe_poisson(t.person_months(), "Rscu_sum", _its_terms(), absorb="uid")
    out = _est(fit.table())
    fit.release()
    return out


@query("m5_fixed_effect_logit")
def person_logit(t: Tables):
    fit = fe_logit(t.person_months(), "Rscu_bi", ["scrub4", "t", "t_scrub4"], absorb="uid")
    out = _est(fit.table())
    fit.release()
    return out


@query(
    "m4_common_step",
    """WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_mktsegment <> 'BUILDING' AND year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1)
       SELECT 'step' AS term, round(ln(sum(CASE WHEN y >= 1998 THEN n END) / sum(CASE WHEN y < 1998 THEN n END)), 5) AS estimate FROM c""",
)
def common_step(t: Tables):
    """In a balanced panel with one step for all areas the slope is the log ratio of totals; rows without an area leave."""
    area = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(area.alias("area"), F.year("o_orderdate").alias("y"))
    counts = joined.filter("y between 1996 and 1999").groupBy("area", "y").agg(F.count(F.lit(1)).alias("n"))
    grid = t.nation.select(F.col("n_nationkey").alias("area"), F.explode(F.sequence(F.lit(1996), F.lit(1999))).alias("y"))
    filled = grid.join(counts, ["area", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0))).unionByName(counts.filter("area is null"))
    fit = fe_poisson(filled.withColumn("step", (F.col("y") >= 1998).cast("double")), "n", ["step"], absorb="area")
    out = fit.table().select("term", F.round("estimate", 5).alias("estimate"))
    fit.release()
    return out


@query(
    "m5_two_periods",
    """WITH p AS (SELECT o_custkey, max(CASE WHEN year(o_orderdate) = 1996 AND o_totalprice > 150000 THEN 1 ELSE 0 END) AS a,
       max(CASE WHEN year(o_orderdate) = 1997 AND o_totalprice > 150000 THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1)
       SELECT 'post' AS term, round(2 * ln(sum(CASE WHEN a < b THEN 1.0 END) / sum(CASE WHEN a > b THEN 1.0 END)), 5) AS estimate FROM p""",
)
def two_periods(t: Tables):
    """With two rows a person the free-effect slope is twice the log ratio of the changes to either side."""
    high = lambda y: F.max(((F.year("o_orderdate") == y) & (F.col("o_totalprice") > 150000)).cast("int"))
    person = t.orders.groupBy(F.col("o_custkey").alias("uid")).agg(high(1996).alias("a"), high(1997).alias("b"))
    rows = person.select("uid", F.explode(F.array(F.struct(F.lit(0.0).alias("post"), F.col("a").alias("z")), F.struct(F.lit(1.0).alias("post"), F.col("b").alias("z")))).alias("r"))
    fit = fe_logit(rows.select("uid", "r.*"), "z", ["post"], absorb="uid")
    out = fit.table().select("term", F.round("estimate", 5).alias("estimate"))
    fit.release()
    return out


@query(
    "m6_deviance_residuals",
    sql_on("area_orders", body="""
        SELECT zip, qtr, round(CASE WHEN n > m THEN 1.0 WHEN n < m THEN -1.0 ELSE 0.0 END * sqrt(greatest(2 * (n * ln(n / m) - (n - m)), 0)), 5) AS resid
        FROM (SELECT zip, qtr, n, avg(n) OVER (PARTITION BY qtr) AS m FROM (SELECT zip, qtr, count(*) AS n FROM area_orders GROUP BY zip, qtr))"""),
)
def residual_rows(t: Tables):
    n = t.area_orders().groupBy("zip", "qtr").agg(F.count(F.lit(1)).alias("n"))
    fit = poisson_glm(n, "n", [Factor("qtr")])
    out = handed_over(deviance_residuals(fit).select("zip", "qtr", (F.round("resid", 5)).alias("resid")), "residuals")
    fit.release()
    return out


_THIN = "o_orderpriority = '1-URGENT' AND o_totalprice > 200000"


@query(
    "m6_lagged_by_period",
    sql_on("area_orders", extra={
        "n": f"SELECT zip, CAST((year - 1992) * 12 + month AS INTEGER) AS t, qtr, count(*) AS n FROM area_orders WHERE {_THIN} GROUP BY 1, 2, 3",
        "r": """SELECT zip, t, CASE WHEN n > m THEN 1.0 WHEN n < m THEN -1.0 ELSE 0.0 END * sqrt(greatest(2 * (n * ln(n / m) - (n - m)), 0)) AS resid
                FROM (SELECT *, avg(n) OVER (PARTITION BY qtr) AS m FROM n)""",
    }, body="SELECT a.zip, a.t, round(b.resid, 5) AS reslag1 FROM r a LEFT JOIN r b ON a.zip = b.zip AND b.t = a.t - 1"),
)
def lagged_months(t: Tables):
    """Areas have months without an order; the month after such a gap has no lagged residual."""
    t_col = ((F.col("year") - 1992) * 12 + F.col("month")).cast("int")
    n = t.area_orders().filter(_THIN).groupBy("zip", t_col.alias("t"), "qtr").agg(F.count(F.lit(1)).alias("n"))
    fit = poisson_glm(n, "n", [Factor("qtr")])
    out = handed_over(lagged_residual(fit, "zip", "t").select("zip", "t", F.round("reslag1", 5).alias("reslag1")), "residuals")
    fit.release()
    return out


@query("m6_logit_refit")
def logit_refit(t: Tables):
    months = t.person_months()
    first = fe_logit(months, "Rscu_bi", ["scrub4", "t", "t_scrub4"], absorb="uid")
    second = fe_logit(lagged_residual(first, "uid", "t"), "Rscu_bi", ["scrub4", "t", "t_scrub4", "reslag1"], absorb="uid")
    out = _est(second.table())
    second.release()
    first.release()
    return out


@query("m6_autocorrelation_refit")
def autocorrelation(t: Tables):
    first = fe_poisson(t.person_months(), "Rscu_sum", ["scrub4", "t", "t_scrub4"], absorb="uid")
    second = fe_poisson(lagged_residual(first, "uid", "t"), "Rscu_sum", ["scrub4", "t", "t_scrub4", "reslag1"], absorb="uid")
    out = _est(second.table())
    second.release()
    first.release()
    return out


# The mean alone, clustered: leverage of a cluster is its share of the rows.
_CLUSTERED_MEAN = """
    SELECT round(ybar, 6) AS estimate, round(sqrt(sum(s * s / (1 - n / big)) / (big * big)), 6) AS se,
           round(power(sum(sj - pj * pj / big), 2) / (sum(sj * sj) - 2 * sum(sj * pj * pj) / big + power(sum(pj * pj), 2) / (big * big)), 5) AS df
    FROM (SELECT k.*, ybar, big, n / (1 - n / big) / (big * big) AS sj, n / sqrt(1 - n / big) / big AS pj FROM
          (SELECT c_nationkey, count(*) * 1.0 AS n, sum(o_totalprice / 1000 - (SELECT avg(o_totalprice / 1000) FROM orders)) AS s
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) k,
          (SELECT avg(o_totalprice / 1000) AS ybar, CAST(count(*) AS DOUBLE) AS big FROM orders))
    GROUP BY ybar, big"""


@query("m7_cluster_se_mean", _CLUSTERED_MEAN)
def clustered_mean(t: Tables):
    rows = t.area_orders().select("zip", (F.col("o_totalprice") / 1000).alias("price"))
    fit = ols(rows, "price", [], cache=False)
    out = cluster_se(fit, "zip").select(
        F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), F.round("df", 5).alias("df")
    )
    fit.release()
    return out


_FIRST = ["(Intercept)", "coalclose", "exposed", "exposed_coalclose"]


@query("m7_cluster_se_did")
def clustered_did(t: Tables):
    fit = ols(t.event_panel(), "asthma_count", ["coalclose", "exposed", "exposed_coalclose", "totpop"], absorb="zip")
    out = cluster_se(fit, "zip", _FIRST)
    fit.release()
    return out


@query("m7_cluster_se_weighted")
def clustered_weighted(t: Tables):
    panel = share_of_total(t.event_panel(), "totpop", "wts")
    fit = wls(panel, "asthma_count", ["coalclose", "exposed", "exposed_coalclose"], weights="wts", absorb="zip")
    out = cluster_se(fit, "zip", _FIRST)
    fit.release()
    return out


@query("m7_cluster_se_poisson")
def clustered_poisson(t: Tables):
    fit = _count_model(t)
    out = cluster_se(fit, "zip", list(STEPS))
    fit.release()
    return out


# Two groups of clusters: a cluster's leverage is its share of its group's rows.
_GROUPS_SE = sql_on("event_panel", extra={
    "r": "SELECT zip, exposed, asthma_count AS y FROM event_panel WHERE exposed IS NOT NULL",
    "g": "SELECT exposed, avg(y) AS m, count(*) * 1.0 AS big FROM r GROUP BY 1",
    # the only cluster of its group fits it exactly and adds nothing
    "k": """SELECT exposed, m, big, n, sy - n * m AS s, CASE WHEN n < big THEN n / (1 - n / big) / (big * big) ELSE 0 END AS sj,
            CASE WHEN n < big THEN n / sqrt(1 - n / big) / big ELSE 0 END AS pj FROM (SELECT zip, exposed, count(*) * 1.0 AS n, sum(y) AS sy FROM r GROUP BY 1, 2) JOIN g USING (exposed)""",
    "v": """SELECT exposed, m, sum(CASE WHEN n < big THEN s * s / (1 - n / big) ELSE 0 END) / (big * big) AS v, sum(sj - pj * pj / big) AS tr,
            sum(sj * sj) - 2 * sum(sj * pj * pj) / big + power(sum(pj * pj), 2) / (big * big) AS sq FROM k GROUP BY exposed, m, big""",
}, body="""SELECT '(Intercept)' AS term, round(m, 6) AS estimate, round(sqrt(v), 6) AS se, round(CASE WHEN sq > 0 THEN tr * tr / sq END, 5) AS df FROM v WHERE exposed = 0 UNION ALL
           SELECT 'exposed', round(b.m - a.m, 6), round(sqrt(a.v + b.v), 6), round(CASE WHEN a.sq + b.sq > 0 THEN power(a.tr + b.tr, 2) / (a.sq + b.sq) END, 5) FROM v a, v b WHERE a.exposed = 0 AND b.exposed = 1""")


@query("m7_cluster_se_groups", _GROUPS_SE)
def clustered_groups(t: Tables):
    fit = ols(t.event_panel(), "asthma_count", ["exposed"])
    out = cluster_se(fit, "zip").select("term", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), F.round("df", 5).alias("df"))
    fit.release()
    return out


# One regressor with absorbed areas that are the clusters: a cluster's leverage is its share of the information.
_SHARES_SE = """SELECT term, round(estimate, 6) AS estimate, round(sqrt(sum(s * s / (1 - info / big))) / big, 6) AS se,
    round(power(sum(sj - pj * pj / big), 2) / (sum(sj * sj) - 2 * sum(sj * pj * pj) / big + power(sum(pj * pj), 2) / (big * big)), 5) AS df
    FROM (SELECT *, info / (1 - info / big) / (big * big) AS sj, info / sqrt(1 - info / big) / big AS pj FROM k) GROUP BY term, estimate, big"""


def _tested(fit, cluster: str):
    out = cluster_se(fit, cluster).select("term", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), F.round("df", 5).alias("df"))
    fit.release()
    return out


@query(
    "m7_cluster_se_within",
    sql_on("panel", extra={
        "d": """SELECT zip, asthma_count - avg(asthma_count) OVER (PARTITION BY zip) AS y,
                tot_exp / 1e6 - avg(tot_exp / 1e6) OVER (PARTITION BY zip) AS x FROM panel WHERE tot_exp IS NOT NULL""",
        "b": "SELECT sum(x * y) / sum(x * x) AS estimate, sum(x * x) AS big FROM d",
        "k": "SELECT 'millions' AS term, zip, estimate, big, sum(x * x) AS info, sum(x * (y - x * estimate)) AS s FROM d, b GROUP BY zip, estimate, big",
    }, body=_SHARES_SE),
)
def clustered_within(t: Tables):
    panel = t.panel().withColumn("millions", F.col("tot_exp") / 1e6)
    return _tested(ols(panel, "asthma_count", ["millions"], absorb="zip"), "zip")


@query(
    "m7_cluster_se_step",
    f"""WITH g AS ({_GRID.format(1994, 1997)}), a AS (SELECT area, sum(n) AS y, sum(n) FILTER (y >= 1996) AS post FROM g GROUP BY area),
    b AS (SELECT sum(post) / sum(y) AS share, sum(y) AS total FROM a),
    k AS (SELECT 'step' AS term, area, ln(share / (1 - share)) AS estimate, total * share * (1 - share) AS big, y * share * (1 - share) AS info,
          post - y * share AS s FROM a, b WHERE y > 0) {_SHARES_SE}""",
)
def clustered_step(t: Tables):
    """A step for all areas in a balanced Poisson panel: every area's expected share after it is the pooled one."""
    rows = _grid(t, 1994, 1997).withColumn("step", (F.col("y") >= 1996).cast("double"))
    return _tested(fe_poisson(rows, "n", ["step"], absorb="area"), "area")


@query(
    "m2_weighted_did_within",
    sql_on("event_panel", extra={
        "m": """SELECT zip, sum(totpop) AS w, sum(totpop * asthma_count) / sum(totpop) AS y, sum(totpop * coalclose) / sum(totpop) AS x1,
                sum(totpop * exposed_coalclose) / sum(totpop) AS x2 FROM event_panel WHERE exposed IS NOT NULL AND totpop IS NOT NULL GROUP BY zip""",
        "g": """SELECT sum(totpop * (coalclose - x1) * (coalclose - x1)) AS a11, sum(totpop * (coalclose - x1) * (exposed_coalclose - x2)) AS a12,
                sum(totpop * (exposed_coalclose - x2) * (exposed_coalclose - x2)) AS a22, sum(totpop * (coalclose - x1) * (asthma_count - y)) AS b1,
                sum(totpop * (exposed_coalclose - x2) * (asthma_count - y)) AS b2 FROM event_panel JOIN m USING (zip) WHERE exposed IS NOT NULL AND totpop IS NOT NULL""",
    }, body="""SELECT 'coalclose' AS term, round((b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12), 5) AS estimate FROM g UNION ALL
               SELECT 'exposed_coalclose', round((b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12), 5) FROM g"""),
)
def weighted_did_within(t: Tables):
    panel = share_of_total(t.event_panel(), "totpop", "wts")
    fit = wls(panel, "asthma_count", ["coalclose", "exposed_coalclose"], weights="wts", absorb="zip")
    out = fit.table().select("term", F.round("estimate", 5).alias("estimate"))
    fit.release()
    return out


@query("m7_cluster_se_exposure")
def clustered_exposure(t: Tables):
    panel = t.panel().withColumn("tot_exp", F.col("tot_exp") / 1000)
    fit = ols(panel, "tot_exp", [*STEPS, Factor("qtr", base=2), *WEATHER], absorb="zip")
    out = cluster_se(fit, "zip", list(STEPS))
    fit.release()
    return out


@query("m7_cluster_se_first_difference")
def clustered_difference(t: Tables):
    # One row an area: the correction is the leverage of a row.
    fit = ols(differences(t), "asthma_diff", [Factor("hyads_group"), "totpop"])
    out = cluster_se(fit, "zip")
    fit.release()
    return out


_CONTINUOUS = ["coalclose", "pre_hyads", "exposed_coalclose_c"]
_ADJUSTED = ["uninsur_p", Factor("qtr", base=2), Factor("year"), "pov_p", "black_p", *WEATHER]


def _with_cluster_se(fit):
    """CR2 tests of the terms that area effects leave identified."""
    out = cluster_se(fit, "zip", _CONTINUOUS)
    fit.release()
    return out


@query(
    "m1_continuous_did_slope",
    sql_on("event_panel", extra={"g": """SELECT sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * y) AS b1, sum(x2 * y) AS b2 FROM
        (SELECT asthma_count - avg(asthma_count) OVER (PARTITION BY zip) AS y, coalclose - avg(coalclose) OVER (PARTITION BY zip) AS x1,
                exposed_coalclose_c - avg(exposed_coalclose_c) OVER (PARTITION BY zip) AS x2 FROM event_panel WHERE pre_hyads IS NOT NULL)"""},
        body="""SELECT 'coalclose' AS term, round((b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12), 5) AS estimate FROM g UNION ALL
                SELECT 'exposed_coalclose_c', round((b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12), 5) FROM g"""),
)
def continuous_slope(t: Tables):
    fit = ols(t.event_panel(), "asthma_count", _CONTINUOUS, absorb="zip")
    out = fit.table(["coalclose", "exposed_coalclose_c"]).select("term", F.round("estimate", 5).alias("estimate"))
    fit.release()
    return out


@query("m1_continuous_did")
def continuous_did(t: Tables):
    return _with_cluster_se(ols(t.event_panel(), "asthma_count", [*_CONTINUOUS, "totpop"], absorb="zip"))


@query("m1_continuous_did_adjusted")
def continuous_did_adjusted(t: Tables):
    return _with_cluster_se(ols(t.event_panel(), "asthma_count", [*_CONTINUOUS, "totpop", *_ADJUSTED], absorb="zip"))


@query("m2_continuous_did_weighted")
def continuous_did_weighted(t: Tables):
    panel = share_of_total(t.event_panel(), "totpop", "wts")
    return _with_cluster_se(wls(panel, "asthma_count", _CONTINUOUS, weights="wts", absorb="zip"))


@query("m2_continuous_did_weighted_adjusted")
def continuous_did_weighted_adjusted(t: Tables):
    panel = share_of_total(t.event_panel(), "totpop", "wts")
    return _with_cluster_se(wls(panel, "asthma_count", [*_CONTINUOUS, *_ADJUSTED], weights="wts", absorb="zip"))


def differences(t: Tables):
    """One row per area: pre/post differences, exposure group, baseline population and weight."""
    from .relations import pre_post_differences

    d = pre_post_differences(t)
    base = t.demographics().filter(F.col("year") == 1997).select(F.col("zcta5a").alias("zip"), "totpop").distinct()
    d = left_join(d, base, ["zip"]).na.drop("any")
    d = d.withColumn("hyads_diff", F.col("hyads_diff") / 1000)
    return d.withColumn("hyads_group", cut_points("hyads_diff", [-200.0, 0.0, 200.0], [4, 3, 2, 1]))


@query("m8_confidence_intervals")
def intervals(t: Tables):
    fit = ols(differences(t), "asthma_diff", ["hyads_diff", "uninsur_diff", "totpop_diff", "Temp_diff", "Pres_diff"])
    out = fit.confint()
    fit.release()
    return out


@query(
    "m8_rate_intervals",
    sql_on("event_panel", extra={"r": _RATES, "e": """
        SELECT '(Intercept)' AS term, ln(y / pop) AS b, sqrt(1 / y) AS se FROM r WHERE exposed = 0 UNION ALL
        SELECT 'exposed', ln(a.y / a.pop) - ln(b.y / b.pop), sqrt(1 / a.y + 1 / b.y) FROM r a, r b WHERE a.exposed = 1 AND b.exposed = 0"""},
        body="SELECT term, round(b, 6) AS estimate, round(b - 1.959963984540054 * se, 6) AS low, round(b + 1.959963984540054 * se, 6) AS high FROM e"),
)
def rate_intervals(t: Tables):
    panel = t.event_panel().withColumn("log_pop", F.log("totpop"))
    fit = poisson_glm(panel, "asthma_count", ["exposed"], offset="log_pop", quasi=False)
    out = fit.confint().select("term", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])
    fit.release()
    return out


@query("m8_weighted_intervals")
def weighted_intervals(t: Tables):
    d = share_of_total(differences(t), "totpop", "wts")
    fit = wls(d, "asthma_diff", ["hyads_diff", "uninsur_diff", "totpop_diff", "Temp_diff", "Pres_diff"], weights="wts")
    out = fit.confint()
    fit.release()
    return out


_THREE = ["l_quantity", "l_discount", "l_extendedprice"]


@query(
    "m9_vif_three",
    "WITH r AS (SELECT corr(l_quantity, l_discount) AS ab, corr(l_quantity, l_extendedprice) AS ac, corr(l_discount, l_extendedprice) AS bc FROM lineitem), "
    "d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r) "
    "SELECT 'l_quantity' AS term, round((1 - bc * bc) / det, 6) AS vif FROM d UNION ALL SELECT 'l_discount', round((1 - ac * ac) / det, 6) FROM d "
    "UNION ALL SELECT 'l_extendedprice', round((1 - ab * ab) / det, 6) FROM d",
)
def inflation_of_three(t: Tables):
    return vif(t.lineitem.select(*_THREE), _THREE, cache=False).withColumn("vif", F.round("vif", 6))


@query(
    "m9_vif",
    "SELECT unnest(['l_quantity', 'l_extendedprice']) AS term, round(1 / (1 - power(corr(l_quantity, l_extendedprice), 2)), 6) AS vif FROM lineitem",
)
def inflation(t: Tables):
    return vif(t.lineitem.select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], cache=False).withColumn("vif", F.round("vif", 6))


@query(
    "m10_predict_by_period",
    sql_on("person_months", body="""SELECT month, CASE WHEN month < 6 THEN 'pre' ELSE 'post' END AS switch, round(avg(Rscu_sum), 6) AS mean_rscu
           FROM person_months GROUP BY 1, 2"""),
)
def predictions(t: Tables):
    # With one dummy per month, the mean prediction of a month is its mean outcome.
    fit = poisson_glm(t.person_months(), "Rscu_sum", [Factor("month")])
    means = handed_over(predict_by(fit, ["month"]), "predicted-means")
    fit.release()
    switch = F.when(F.col("month") < 6, "pre").when(F.col("month") >= 6, "post")
    return means.select("month", switch.alias("switch"), F.round("mean_predicted", 6).alias("mean_rscu"))


@query(
    "m10_predict_person_totals",
    sql_on("person_months", body="SELECT uid, round(sum(Rscu_sum), 7) AS total FROM person_months GROUP BY uid"),
)
def person_totals(t: Tables):
    # Each absorbed effect reproduces its person's total.
    fit = fe_poisson(t.person_months(), "Rscu_sum", ["scrub4", "t", "t_scrub4"], absorb="uid")
    out = handed_over(predict(fit, "mu").groupBy("uid").agg(F.round(F.sum("mu"), 7).alias("total")), "person-totals")
    fit.release()
    return out


@query(
    "m11_inverse_link",
    sql_on("event_panel", extra={"r": _RATES}, body="""
        SELECT 'exposed' AS term, round((a.y / a.pop) / (b.y / b.pop), 7) AS rate_ratio,
               round((a.y / a.pop) / (b.y / b.pop) / (1 + (a.y / a.pop) / (b.y / b.pop)), 7) AS inverse_logit
        FROM r a, r b WHERE a.exposed = 1 AND b.exposed = 0"""),
)
def response_scale(t: Tables):
    fit = poisson_glm(t.event_panel().withColumn("log_pop", F.log("totpop")), "asthma_count", ["exposed"], offset="log_pop")
    out = fit.table(["exposed"]).select(
        "term", F.round(inverse_link("estimate", "poisson"), 7).alias("rate_ratio"),
        F.round(inverse_link("estimate", "binomial"), 7).alias("inverse_logit"),
    )
    fit.release()
    return out


@query(
    "m12_model_summary",
    """SELECT 'n' AS name, CAST(regr_count(l_extendedprice, l_quantity) AS DOUBLE) AS value FROM lineitem UNION ALL
       SELECT 'r2', round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem UNION ALL
       SELECT 'df_resid', CAST(count(*) - 2 AS DOUBLE) FROM lineitem UNION ALL
       SELECT 'sigma', round(sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2)
              / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 6) FROM lineitem""",
)
def model_summary(t: Tables):
    fit = ols(t.lineitem.select("l_extendedprice", "l_quantity"), "l_extendedprice", ["l_quantity"], cache=False)
    out = fit.summary().filter(F.col("name").isin("n", "r2", "df_resid", "sigma")).withColumn("value", F.round("value", 6))
    fit.release()
    return out


# Within-area normal equations for the two columns that area dummies leave identified.
_TWO = """
    SELECT 'coalclose' AS term, round((b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12), 5) AS estimate FROM g UNION ALL
    SELECT 'exposed_coalclose', round((b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12), 5) FROM g"""
_DEMEANED = """SELECT sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * y) AS b1, sum(x2 * y) AS b2 FROM
    (SELECT asthma_count - avg(asthma_count) OVER (PARTITION BY zip) AS y, coalclose - avg(coalclose) OVER (PARTITION BY zip) AS x1,
            exposed_coalclose - avg(exposed_coalclose) OVER (PARTITION BY zip) AS x2 FROM event_panel WHERE exposed IS NOT NULL)"""


@query("m14_aliased_did", sql_on("event_panel", extra={"g": _DEMEANED}, body=_TWO))
def aliased(t: Tables):
    fit = ols(t.event_panel(), "asthma_count", ["coalclose", "exposed", "exposed_coalclose", Factor("zip")])
    if len(fit.aliased) != 1:
        raise ValueError(f"expected one collinear dummy, found {fit.aliased}")
    out = fit.table(["coalclose", "exposed_coalclose"]).select("term", F.round("estimate", 5).alias("estimate"))
    fit.release()
    return out


def _differences_sql() -> dict[str, str]:
    from .relations import POST_SQL, PRE_SQL, _MEASURES, strict_when

    names = list(_MEASURES)
    changes = ", ".join(f"{strict_when(POST_SQL, c)} - {strict_when(PRE_SQL, c)} AS {n}" for n, c in _MEASURES.items())
    return {
        "changes": f"SELECT zip, {changes} FROM panel GROUP BY zip",
        "d": f"""SELECT c.zip, asthma_diff AS y, b.totpop AS x, CASE WHEN hyads_diff / 1000 < -200 THEN 4 WHEN hyads_diff < 0 THEN 3
                 WHEN hyads_diff / 1000 < 200 THEN 2 ELSE 1 END AS k FROM changes c JOIN demographics b ON c.zip = b.zcta5a AND b.year = 1997
                 WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)}""",
        "m": """SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy,
                var_pop(y) * count(*) AS syy FROM d GROUP BY k""",
        "t": """SELECT sum(sxy) / sum(sxx) AS b, sum(sxx) AS sxx, (sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(n) - count(*) - 1) AS s2 FROM m""",
        "z": "SELECT * FROM m ORDER BY k LIMIT 1",
    }


@query(
    "m1_first_difference_groups",
    sql_on("panel", extra=_differences_sql(), body="""
        SELECT '(Intercept)' AS term, round(my - b * mx, 5) AS estimate, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 5) AS se FROM (SELECT z.n, z.mx, z.my, t.* FROM z, t) UNION ALL
        SELECT 'hyads_group' || m.k, round(m.my - z.my - b * (m.mx - z.mx), 5), round(sqrt(s2 * (1.0 / m.n + 1.0 / z.n + power(m.mx - z.mx, 2) / t.sxx)), 5)
        FROM m, z, t WHERE m.k <> z.k UNION ALL SELECT 'totpop', round(b, 5), round(sqrt(s2 / sxx), 5) FROM t"""),
)
def difference_groups(t: Tables):
    fit = ols(differences(t), "asthma_diff", [Factor("hyads_group"), "totpop"])
    out = _est(fit.table())
    fit.release()
    return out


@query("m2_weighted_first_difference")
def weighted_difference(t: Tables):
    d = share_of_total(differences(t), "totpop", "wts")
    fit = wls(d, "asthma_diff", ["hyads_diff", "uninsur_diff", "totpop_diff", "Temp_diff", "Pres_diff"], weights="wts")
    out = _est(fit.table())
    fit.release()
    return out


@query("m5_high_use_poisson")
def high_use(t: Tables):
    months = t.person_months().withColumn("high", (F.col("Rscu_sum") > 4).cast("double"))
    months = interaction(months.drop("t_scrub4"), "t_scrub4", "t", "scrub4")
    fit = fe_poisson(months, "high", ["scrub4", "t", "t_scrub4"], absorb="uid")
    out = _est(fit.table())
    fit.release()
    return out


@query(
    "m7_hc2_first_difference",
    sql_on("panel", extra={**_differences_sql(), "e": """
        SELECT d.x - m.mx AS x, d.y - m.my - t.b * (d.x - m.mx) AS e, 1.0 / m.n + power(d.x - m.mx, 2) / t.sxx AS h, t.b, t.sxx FROM d JOIN m USING (k), t"""},
        body="SELECT 'totpop' AS term, round(any_value(b), 6) AS estimate, round(sqrt(sum(x * x * e * e / (1 - h))) / any_value(sxx), 6) AS se FROM e WHERE h < 1 - 1e-9"),
)
def leverage_of_a_row(t: Tables):
    # With one row a cluster the correction divides by what the row leaves of itself.
    fit = ols(differences(t), "asthma_diff", [Factor("hyads_group"), "totpop"])
    out = cluster_se(fit, "zip", ["totpop"]).select("term", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"))
    fit.release()
    return out

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.functions.bases import natural_spline_basis
from panelspark.functions.columns import cut_points, period_index, relabel, relative_change, row_total, share_of_total, step_events
from panelspark.functions.dates import base_periods, event_window, from_serial
from panelspark.functions.nulls import indicator, n_distinct_with_null, strict_avg, strict_sum, strict_sum_where
from panelspark.functions.text import reduction_label, unit_title
from panelspark.operators import aggregates as agg
from panelspark.operators.cohort import k_distinct_cohort, observed_in_all
from panelspark.operators.contrasts import exposed_groups, pre_post_diff
from panelspark.operators.joins import natural_left_join, restrict_to_cohort, shared_columns, suffix_left_join
from panelspark.operators.ranks import average_ranks, exact_quantiles, global_row_number, null_safe_ntile
from panelspark.operators.reshape import pivot_units
from panelspark.operators.spatial import change_from_base, crosswalk, mean_change_labels, polygon_area, ring_area
from panelspark.operators.windows import entry_exit, first_last_row, follow_up, lag_by, row_slice
from panelspark.sources.tables import period_dim, read_delimited, write_delimited


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [("none", 1.0), ("none", 3.0), ("some", 2.0), ("some", None), ("all", None), ("all", None)]
    return spark.createDataFrame(rows, "g string, x double").repartition(4)


def test_strict_aggregates(gaps):
    got = {r["g"]: r for r in gaps.groupBy("g").agg(
        strict_sum("x").alias("s"), strict_avg("x").alias("m"), F.avg("x").alias("lenient"), n_distinct_with_null("x").alias("d"),
        strict_sum_where(F.col("x") > 2, "x").alias("w"),
    ).collect()}
    assert (got["none"]["s"], got["none"]["m"], got["none"]["d"], got["none"]["w"]) == (4.0, 2.0, 2, 3.0)
    assert (got["some"]["s"], got["some"]["m"], got["some"]["lenient"], got["some"]["d"]) == (None, None, 2.0, 2)
    assert (got["all"]["s"], got["all"]["d"], got["all"]["w"]) == (None, 1, None)


def test_null_guarded_columns(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 20.0)], "t int, x double")
    rows = {r["t"]: r for r in row_total(step_events(df, "t", {"s": 1}), "tot", ["x", "t"]).select(
        "t", "s", "tot", indicator(F.col("x") > 10).alias("i"), cut_points("x", [5, 10]).alias("c"),
        cut_points("x", [5, 10], [9, 8, 7]).alias("k"), relative_change("x", F.lit(0.0)).alias("z"),
    ).collect()}
    assert [rows[t]["i"] for t in (1, 2, 3)] == [0, None, 1]
    assert [rows[t]["c"] for t in (1, 2, 3)] == [1, None, 2]
    assert rows[1]["k"] == 8 and rows[2]["tot"] is None and rows[3]["s"] == 1 and rows[1]["z"] is None


def test_period_index_and_labels(spark):
    df = spark.createDataFrame([(2015, 5), (2017, 5), (2015, 4), (2017, 6)], "y int, m int")
    got = [r[0] for r in df.select(period_index("y", "m", (2015, 5), 12, 25)).collect()]
    assert got == [1, 25, None, None]
    r = relabel(spark.createDataFrame([("b",), ("z",)], "u string"), "u", ["a", "b"], ["A", "B"]).collect()
    assert (r[0]["u_f"], r[0]["u_f_ord"], r[1]["u_f"], r[1]["u_f_ord"]) == ("B", 2, None, None)
    shares = share_of_total(spark.createDataFrame([(1,), (3,)], "n int"), "n", "w").collect()
    assert sorted(r["w"] for r in shares) == [0.25, 0.75]


@pytest.mark.parametrize("start,base,plot", [
    (None, ["2014.1", "2014.4"], ["2015.1", "2015.4"]), (1, ["2014.1", "2014.4"], ["2015.1", "2015.4"]),
    (3, ["2014.3", "2015.2"], ["2015.3", "2016.2"]),
])
def test_base_periods(start, base, plot):
    b, p = base_periods(2014, start, 4)
    assert (b.labels()[0], b.labels()[-1]) == tuple(base) and (p.labels()[0], p.labels()[-1]) == tuple(plot)


def test_base_period_of_a_month_late_in_the_year(spark):
    b, _ = base_periods(2014, 12, 12)
    assert b.labels() == ["2014.12"] + [f"2015.{m}" for m in range(1, 12)]
    rows = spark.createDataFrame([(2014, 11), (2014, 12), (2015, 11), (2015, 12)], "y int, m int")
    assert [r[0] for r in rows.select(b.contains("y", "m")).collect()] == [False, True, True, False]


def test_serial_dates_and_event_sides(spark):
    row = one(spark.createDataFrame([(42529,)], "n int").select(from_serial("n").alias("d"), from_serial("n", "1900-01-01").alias("l")))
    assert (row["d"], row["l"]) == (dt.date(2016, 6, 8), dt.date(2016, 6, 10))
    days = [(dt.date(2016, 6, 8) + dt.timedelta(days=k),) for k in (-365, -364, 0, 1, 364, 365)] + [(None,)]
    got = [r[0] for r in spark.createDataFrame(days, "d date").select(event_window("d", "2016-06-08", 365, 365)).collect()]
    assert got == [0, 1, 1, 2, 2, 0, 0]


def test_cohorts_literal_and_intended(spark):
    rows = [(f"{a}{b}{c}", s) for a in (0, 1) for b in (0, 1) for c in (0, 1) for s, on in ((0, a), (1, b), (2, c)) if on]
    df = spark.createDataFrame(rows, "uid string, side int").repartition(3)
    assert {r[0] for r in observed_in_all(df, "uid", "side", [1, 2]).collect()} == {"011", "111"}
    assert {r[0] for r in k_distinct_cohort(df, "uid", "side", 2).collect()} == {"011", "101", "110"}
    ids = spark.createDataFrame([("011",), ("nobody",)], "ids string")
    kept = restrict_to_cohort(ids, df, "ids", "uid")
    assert {(r["ids"], r["side"]) for r in kept.collect()} == {("011", 1), ("011", 2), ("nobody", None)}
    assert restrict_to_cohort(ids, df, "ids", "uid", keep_unmatched=False).count() == 2


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, w int")
    assert {(r["k"], r["w"]) for r in natural_left_join(a, b).collect()} == {("x", 10), (None, None)}
    assert {(r["k"], r["w"]) for r in natural_left_join(a, b, nulls_match=True).collect()} == {("x", 10), (None, 20)}
    assert suffix_left_join(a, a, ["k"]).columns == ["k", "v_x", "v_y"]
    with pytest.raises(ValueError):
        shared_columns(a, spark.createDataFrame([(1,)], "z int"))


def test_pivot_rejects_duplicate_keys(spark):
    rows = [("z1", "u1", 1.0), ("z1", "u2", 2.0), ("z2", "u1", None)]
    df = spark.createDataFrame(rows, "z string, u string, x double")
    got = {r["z"]: (r["a"], r["b"]) for r in pivot_units(df, ["z"], "u", "x", ["u1", "u2"], ["a", "b"]).collect()}
    assert got == {"z1": (1.0, 2.0), "z2": (None, None)}
    with pytest.raises(PySparkException):
        pivot_units(df.union(df), ["z"], "u", "x", ["u1", "u2"]).collect()


def test_pre_post_equals_the_step_by_step_route(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(z, q, rng.normal(), rng.normal()) for z in "abc" for q in range(1, 10)], columns=["z", "q", "x", "y"])
    pdf.loc[(pdf.z == "b") & (pdf.q == 2), "y"] = None
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.values.tolist()], "z string, q long, x double, y double")
    got = {r["z"]: r for r in pre_post_diff(df, ["z"], F.col("q") <= 4, F.col("q") >= 6, {"dx": "x", "dy": "y"}).collect()}
    for z, g in pdf.groupby("z"):
        assert got[z]["dx"] == pytest.approx(g[g.q >= 6].x.sum() - g[g.q <= 4].x.sum())
    assert got["b"]["dy"] is None and got["a"]["dy"] is not None
    e = {r["z"]: r["exposed"] for r in exposed_groups(df, ["z"], F.col("q") <= 4, "x", threshold=-100.0).collect()}
    assert set(e.values()) == {1}


def test_entry_exit_and_follow_up(spark):
    d = dt.date
    rows = [("a", d(2015, 1, 3)), ("a", d(2015, 3, 1)), ("b", d(2016, 5, 5)), ("b", None)]
    df = spark.createDataFrame(rows, "id string, day date")
    got = {r["id"]: r for r in follow_up(df, "id", "day").collect()}
    assert (got["a"]["duration"], got["a"]["entry_yr"], got["b"]["exit"]) == (57, 2015, d(2016, 5, 5))
    literal = {r["id"]: r["exit"] for r in entry_exit(df, "id", "day", nulls_last=True).collect()}
    assert literal["b"] is None
    last = {r["id"]: r["day"] for r in first_last_row(df, "id", "day", last=True).collect()}
    assert last == {"a": d(2015, 3, 1), "b": None}


def test_lag_within_and_across_ids(spark):
    rows = [("a", 1, 1.0), ("a", 3, 3.0), ("b", 1, 10.0), ("b", 2, 20.0)]
    df = spark.createDataFrame(rows, "id string, t int, x double").repartition(3)
    within = {(r["id"], r["t"]): r["p"] for r in lag_by(df, "id", "t", "x", "p").collect()}
    assert within == {("a", 1): None, ("a", 3): 1.0, ("b", 1): None, ("b", 2): 10.0}
    across = {(r["id"], r["t"]): r["p"] for r in lag_by(df, "id", "t", "x", "p", across=True).collect()}
    assert across == {("a", 1): None, ("a", 3): 1.0, ("b", 1): 3.0, ("b", 2): 10.0}


def test_calendar_month_label_is_the_last_observed_day(spark):
    d = dt.date
    rows = [(1, d(2015, 5, 2), 1.0), (1, d(2015, 5, 20), 3.0), (1, d(2015, 7, 1), 5.0), (2, d(2015, 5, 31), None)]
    df = spark.createDataFrame(rows, "id int, day date, x double")
    got = {(r["id"], r["period"]): (r["date_last"], r["m"]) for r in agg.period_apply(df, ["id"], "day", "month", {"m": strict_avg("x")}).collect()}
    assert got[(1, d(2015, 5, 1))] == (d(2015, 5, 20), 2.0)
    assert got[(2, d(2015, 5, 1))] == (d(2015, 5, 31), None)
    assert len(got) == 3


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([np.full(3000, 4.0), rng.integers(0, 12, 3000), rng.normal(5, 3, 3000).round(3)])
    g = np.where(np.arange(9000) % 3 == 0, "hot", [f"g{i % 40}" for i in range(9000)])
    pdf = pd.DataFrame({"id": np.arange(9000), "g": g, "x": x, "y": x + rng.normal(0, 2, 9000).round(1)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("id") % 50 != 7, F.col("x"))).repartition(11)
    pdf.loc[pdf.id % 50 == 7, "x"] = np.nan
    return pdf, df.persist()


def test_exact_quantiles_with_a_hot_value(skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    row = one(exact_quantiles(df, "x", probs))
    assert np.allclose(list(row), np.nanquantile(pdf.x, probs))
    got = exact_quantiles(df, "x", [0.25, 0.75], by=["g"]).toPandas().set_index("g")
    want = pdf.groupby("g").x.quantile([0.25, 0.75]).unstack()
    assert np.allclose(got.loc[want.index, ["q25", "q75"]], want)


def test_ranks_match_pandas(skewed):
    pdf, df = skewed
    want = pdf.assign(r=pdf.x.rank()).dropna().groupby("x").r.first()
    got = average_ranks(df, "x").toPandas().set_index("value")["rank"]
    assert np.allclose(got.loc[want.index], want)
    rho = one(agg.spearman(df, "x", "y"))["rho"]
    assert rho == pytest.approx(pdf[["x", "y"]].corr(method="spearman").iloc[0, 1], rel=1e-9)
    cells = agg.corr_matrix(df, ["x", "y"], "spearman").toPandas()
    assert cells[cells.i != cells.j].value.tolist() == pytest.approx([rho, rho])


def test_ranks_at_and_between_cuts(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([np.full(900, np.inf), np.full(700, -np.inf), np.full(600, 0.0), np.full(500, -0.0), rng.normal(0, 1, 4000).round(3)])
    pdf = pd.DataFrame({"g": np.where(np.arange(len(x)) % 3 == 0, "a", "b"), "x": x})
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("x") != 0.5, F.col("g"))).repartition(7)
    pdf = pdf[pdf.x != 0.5]  # these have no group
    for cuts, tasks in ((None, None), (None, 100), ([-np.inf, np.inf], 1), ([-np.inf, -1.0, -0.001, 0.0, 0.7, np.inf], 20)):
        got = average_ranks(df, "x", ["g"], cuts, tasks).toPandas()
        assert len(got) == sum(pdf[pdf.g == g].x.nunique() for g in "ab") and got.cnt.sum() == len(pdf)
        want = pdf.assign(r=pdf.groupby("g").x.rank()).groupby(["g", "x"]).r.first()
        assert np.allclose(got.set_index(["g", "value"])["rank"].loc[want.index], want)


def test_ntile_is_exact_and_skips_nulls(skewed):
    pdf, df = skewed
    got = null_safe_ntile(df.select("id", "x"), "x", 10, ["id"], "tile").toPandas().set_index("id").tile
    present = pdf.dropna().sort_values(["x", "id"])
    n, k = len(present), 10
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    want = pd.Series(np.repeat(np.arange(1, k + 1), sizes), index=present.id)
    assert (got.loc[want.index] == want).all() and got[pdf[pdf.x.isna()].id].isna().all()
    numbered = global_row_number(df.select("id"), ["id"], "rn").toPandas()
    assert (numbered.rn == numbered.id + 1).all()


def test_ntile_with_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, None)], "id int, x double")
    got = {r["id"]: r["t"] for r in null_safe_ntile(df, "x", 10, ["id"], "t").collect()}
    assert got == {1: 1, 2: 2, 3: None}


def test_summaries(skewed):
    pdf, df = skewed
    r = one(agg.six_number(df, "x"))
    assert (r["min"], r["max"], r["n_null"]) == (pdf.x.min(), pdf.x.max(), int(pdf.x.isna().sum()))
    assert r["median"] == pytest.approx(pdf.x.median()) and r["mean"] == pytest.approx(pdf.x.mean())
    assert {r["g"]: r["q1"] for r in agg.group_profile(df, ["g"], "x").collect()}["hot"] is None  # it has missing values
    assert agg.freq_table(df, "x").agg(F.sum("n")).head()[0] == pdf.x.notna().sum()
    h = agg.histogram(df, "x", 20).toPandas()
    assert h.n.sum() == pdf.x.notna().sum() and h.bin.between(1, 20).all()
    lo, w = pdf.x.min(), (pdf.x.max() - pdf.x.min()) / 19
    for b in h.itertuples():
        inside = pdf.x[(pdf.x > lo + (b.bin - 1.5) * w) & (pdf.x <= lo + (b.bin - 0.5) * w)]
        assert len(inside) == b.n
    same = agg.histogram_all(df, ["x", "y"], 20).filter("key = 'x'").toPandas()
    assert same.n.sum() == h.n.sum()


def test_constant_column_histogram(spark):
    h = agg.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 5).collect()
    assert [(r["bin"], r["n"]) for r in h] == [(1, 2)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e3, 1e3)), min_size=1, max_size=40), st.integers(1, 6))
def test_quantiles_do_not_depend_on_partitioning(spark, values, parts):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    got = exact_quantiles(df, "x", [0.3, 0.5]).collect()
    present = [v for v in values if v is not None]
    if not present:
        assert not got or got[0][0] is None
    else:
        assert list(got[0]) == pytest.approx(list(np.quantile(present, [0.3, 0.5])), rel=1e-9, abs=1e-9)


def test_spline_basis_keeps_nulls_and_is_linear_outside(spark):
    df = spark.createDataFrame([(None,), (12.0,), (14.0,), (16.0,)], "x double")
    b = df.select(*[c.alias(f"b{i}") for i, c in enumerate(natural_spline_basis("x", [0.0, 4.0, 10.0]))]).collect()
    assert b[0]["b1"] is None
    assert b[3]["b1"] - b[2]["b1"] == pytest.approx(b[2]["b1"] - b[1]["b1"])
    with pytest.raises(ValueError):
        natural_spline_basis("x", [0.0, 0.0, 10.0])


def test_polygon_area_of_known_shapes(spark):
    r2 = 6371010.0**2
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    octant = [(0.0, 0.0), (90.0, 0.0), (0.0, 89.999999), (0.0, 0.0)]
    hole = [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25)]
    df = spark.createDataFrame([(square, octant, hole, [square, hole])], "s array<struct<x:double,y:double>>, o array<struct<x:double,y:double>>, h array<struct<x:double,y:double>>, r array<array<struct<x:double,y:double>>>")
    got = one(df.select(ring_area("s").alias("s"), ring_area("o").alias("o"), ring_area("h").alias("h"), polygon_area("r").alias("r")))
    assert got["o"] == pytest.approx(4 * math.pi * r2 / 8, rel=1e-6)
    box = r2 * math.radians(1) * math.sin(math.radians(1))
    assert got["s"] == pytest.approx(box, rel=1e-4)
    assert got["r"] == pytest.approx(got["s"] - got["h"], rel=1e-12)


def test_change_from_base(spark):
    rows = [(z, y, q, u, float(v)) for z, k in (("00001", 1), ("00002", 0)) for y, q, v in
            [(2014, 3, 10 * k), (2014, 4, 20 * k), (2015, 1, 40), (2015, 3, 5), (2015, 4, 30), (2016, 1, 20), (2016, 4, 99)] for u in ("R-1", "N-1")]
    rows = [(z, y, q, u, v if u == "R-1" else 1000.0) for z, y, q, u, v in rows]
    df = spark.createDataFrame(rows, "ZIP string, year int, quarter int, uID string, exposure double")
    areas = spark.createDataFrame([("00001",), ("00002",)], "ZIP string")
    out = change_from_base(df, areas, "R", "quarter", 2014, 3, "pct")
    got = {(r["ZIP"], r["year"], r["period"]): (r["mean_y"], r["change"]) for r in out.collect()}
    assert got[("00001", 2015, 3)] == (10.0, -0.5) and got[("00001", 2016, 1)] == (40.0, -0.5)
    assert got[("00002", 2015, 3)] == (0.0, None)  # zero base
    assert ("00001", 2016, 4) not in got and ("00001", 2014, 3) not in got
    labels = {(r["year"], r["period"]): (r["mean_p"], r["label"]) for r in mean_change_labels(out).collect()}
    assert labels[(2016, 1)] == (-0.5, "mean reduction = 50%") and labels[(2015, 3)][0] is None


def test_labels(spark):
    df = spark.createDataFrame([(0.231, "1364-3"), (-0.25, "1363|983"), (0.03, "999-1")], "m double, u string")
    got = df.select(reduction_label("m").alias("l"), unit_title("u").alias("t")).collect()
    assert [r["l"] for r in got] == ["mean reduction = -24%", "mean reduction = 24%", "mean reduction = -4%"]
    assert [r["t"] for r in got] == ["Mill Creek Unit 3", "Select units'", "Select units'"]


def test_crosswalk_and_calendar(spark):
    areas = spark.createDataFrame([("A",), ("B",)], "ZCTA string")
    cw = spark.createDataFrame([("A", 501), ("A", 40202), ("C", 1)], "ZCTA string, ZIP int")
    assert {(r["ZCTA"], r["ZIP"]) for r in crosswalk(areas, cw).collect()} == {("A", "00501"), ("A", "40202")}
    dim = period_dim(spark, "2012-01-01", "2017-10-01").collect()
    assert len(dim) == 24 and (dim[0]["year"], dim[0]["quarter"]) == (2012, 1)


def test_text_scan_keeps_codes_and_missing_values(spark, tmp_path):
    df = spark.createDataFrame([("00501", 1.5), ("40202", None)], "zip string, x double")
    back = read_delimited(spark, write_delimited(df, str(tmp_path / "t")), "zip string, x double")
    assert {tuple(r) for r in back.collect()} == {("00501", 1.5), ("40202", None)}
    assert [r["zip"] for r in row_slice(back, "zip", 2, 2).collect()] == ["40202"]


def test_stack_and_triangle(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 1.0)], "d int, u string, v double")
    got = {(r["d"], r["u"]): (r["ymin"], r["ymax"]) for r in agg.stack_offsets(df, "d", "u", "v").collect()}
    assert got == {(1, "a"): (0.0, 2.0), (1, "b"): (2.0, 5.0), (2, "a"): (0.0, 1.0)}
    m = agg.corr_matrix(spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 4.0), (3.0, 5.0, 1.0)], "a double, b double, c double"), ["a", "b", "c"])
    assert agg.triangle(m).count() == 6 and agg.triangle(m, upper=False).count() == 6
    assert agg.corr_of_matrix(m).count() == 9

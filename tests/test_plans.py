"""Registered queries against their SQL at the smallest scale, and the registry's own promises."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelspark.plans import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
CHECKED = [
    "q4_parallel_trends", "i3_pre_post_diff", "n4_change_from_base_quarterly", "q7_change_map_labels", "e5_k_distinct_cohort",
    "e5_observed_in_all", "e6_group_profile", "e9_six_number", "e14_spearman", "f3_null_safe_ntile", "f6_follow_up",
    "j5_period_apply_person_month", "d3_natural_join_null_keys", "l3_natural_spline", "m1_did_saturated", "m7_cluster_se_mean",
    "m14_aliased_did", "n3_polygon_area", "a3_spreadsheet_export", "q5_unit_quarter_series",
    "a4_boundary_table", "b18_level_order", "d6_many_to_many_join", "n2_crosswalk", "m1_two_way_slope", "m3_two_way_step", "m6_lagged_by_period",
    "m7_cluster_se_groups", "m7_cluster_se_within", "m7_cluster_se_step", "m8_rate_intervals", "m9_vif_three", "q9_predicted_by_year",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(cols, found):
    return sorted(tuple("NULL" if v is None else repr(v) if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = rows(cols, ([r[c] for c in cols] for r in df.collect()))
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = rows(cols, ([r[names.index(c)] for c in cols] for r in cur.fetchall()))
    assert got == want


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(QUERIES) - set(ORACLE)
    assert all(n.split("_")[0] in {"m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8", "q9"} for n in without)


def test_scans_read_only_the_columns_they_need(spark):
    plan = QUERIES["q8_mean_daily_use"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_totalprice" in plan
    schema = plan.split("ReadSchema:")[1]
    assert "o_orderstatus" not in schema and "o_custkey" not in schema


def test_area_join_is_left_to_the_planner(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["d2_left_join_other_keys"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and "CartesianProduct" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

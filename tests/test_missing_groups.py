"""Rows without a group id leave absorbed models, whatever groups are large enough to be cut into parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.models import spread as spread_module
from panelspark.models.fixed import fe_logit, fe_poisson
from panelspark.models.linear import ols
from panelspark.operators.reshape import pivot_units, unpivot
from panelspark.operators.windows import first_last_row


def panel(spark, missing, large):
    """40 ids of 12 rows, `large` more rows of the first id, `missing` rows without an id and of another slope."""
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.repeat(np.arange(40.0), 12), np.zeros(large), np.full(missing, np.nan)])
    x = rng.normal(size=len(ids)).round(3)
    y = rng.poisson(np.exp(0.2 * np.nan_to_num(ids) / 40 + np.where(np.isnan(ids), -0.7, 0.5) * x))
    rows = [(None if np.isnan(i) else int(i), float(a), int(b), int(b > 0)) for i, a, b in zip(ids, x, y)]
    return spark.createDataFrame(rows, "id long, x double, y long, z int")


@pytest.mark.parametrize("missing, large", [(60, 0), (60, 900), (900, 0), (900, 900)])
def test_absorbed_models_leave_out_missing_ids(spark, monkeypatch, missing, large):
    monkeypatch.setattr(spread_module, "SMALL_GROUP", 100)
    df = panel(spark, missing, large)
    for fit in (lambda d: fe_poisson(d, "y", ["x"], "id"), lambda d: fe_logit(d, "z", ["x"], "id"), lambda d: ols(d, "y", ["x"], absorb="id")):
        got, want = fit(df), fit(df.filter(F.col("id").isNotNull()))
        assert got.design.n == want.design.n and got.stats["groups"] == want.stats["groups"]
        assert np.allclose(got.coef, want.coef, rtol=1e-6)
        got.release()
        want.release()


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + i % 3) for i in range(20)] + [(float("nan"), 1.0), (3.0, float("nan"))], "x double, y double")
    fit = ols(df, "y", ["x"])
    assert fit.design.n == 20 and np.isfinite(fit.coef).all()
    fit.release()


def test_a_large_group_of_equal_rows_fills_all_parts(spark):
    df = spark.createDataFrame([(1, float(i % 2)) for i in range(20000)] + [(2, 0.0)], "id long, v double").repartition(4)
    spread = spread_module.spread_rows(df, "id", 20001)
    sizes = [r["count"] for r in spread.rows.filter("id = 1").groupBy(spread_module.PART).count().collect()]
    assert len(sizes) == spread.parts and max(sizes) < 2 * 20000 / spread.parts
    spread.release()


def test_reshapes_keep_types(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(1, "a", big, "u"), (1, "b", 7, "v")], "k int, unit string, n long, s string")
    assert tuple(pivot_units(df, ["k"], "unit", "n", ["a", "b"]).first()) == (1, big, 7)
    assert tuple(pivot_units(df, ["k"], "unit", "s", ["a", "b"]).first()) == (1, "u", "v")
    long = unpivot(df.select("k", F.col("n").alias("p"), (F.col("n") + 1).alias("q")), ["k"], ["p", "q"])
    assert dict(long.dtypes)["value"] == "bigint" and big in {r["value"] for r in long.collect()}


def test_first_row_with_tied_dates(spark):
    df = spark.createDataFrame([(1, "d1", 3), (1, "d1", 2), (1, "d2", 9), (2, None, 5)], "id int, day string, seq int")
    assert sorted(map(tuple, first_last_row(df, "id", "day", ties=["seq"]).collect())) == [(1, "d1", 2), (2, None, 5)]

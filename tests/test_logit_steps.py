"""Fixed-effect logit where plain Newton steps fail or no finite estimate exists, and residuals by period."""

import os

import numpy as np
import pandas as pd
import pytest

from panelspark.models import deviance_residuals, fe_logit, fe_poisson, lagged_residual
from panelspark.session import shared_dir


def newton(x, y, g, rounds, damped):
    """(coefficients, likelihoods) of the slope and one effect per group."""
    d = np.column_stack([x, *[(g == k).astype(float) for k in np.unique(g)]])
    b = np.concatenate([np.zeros(x.shape[1]), [np.log(y[g == k].mean() / (1 - y[g == k].mean())) for k in np.unique(g)]])
    side = np.where(y > 0.5, 1, -1)
    ll = lambda b: -(np.log1p(np.exp(-np.abs(d @ b))) + np.maximum(-side * (d @ b), 0)).sum()
    found = [ll(b)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ b, -700, 700)))
        v = np.maximum(p * (1 - p), 1e-12)
        step = np.linalg.solve((d * v[:, None]).T @ d, d.T @ (y - p))
        while damped and ll(b + step) < ll(b) - 1e-12:
            step = step / 2
        b = b + step
        found.append(ll(b))
    return b, found


def test_a_plain_step_diverges_a_halved_one_does_not(spark):
    rng = np.random.default_rng(21)
    g = np.repeat(np.arange(2), 40)
    x = np.where(rng.uniform(size=80) < 0.9, rng.normal(size=80) * 0.3, rng.normal(size=80) * 30)
    y = (rng.uniform(size=80) < 1 / (1 + np.exp(-(3 * np.clip(x, -2, 2) - 4 + 8 * g)))).astype(float)
    plain, found = newton(x[:, None], y, g, 8, False)
    assert found[-1] < found[0] - 1e6
    want, found = newton(x[:, None], y, g, 200, True)
    fit = fe_logit(spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y})), "y", ["x"], absorb="g")
    assert fit["x"] == pytest.approx(want[0], rel=1e-5) and fit.stats["deviance"] == pytest.approx(-2 * found[-1], rel=1e-9)
    assert fit.stats["groups_separated"] == 0
    fit.release()


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(14), 12), "t": np.tile(np.arange(12.0), 14)})
    pdf["x"] = rng.normal(size=len(pdf))
    pdf["z"] = 0.0
    pdf["y"] = (rng.uniform(size=len(pdf)) < 1 / (1 + np.exp(-(0.7 * pdf.x + 0.1 * pdf.t - 0.5)))).astype(float)
    return pdf


def test_groups_that_a_term_splits_are_dropped_and_reported(spark, people):
    split = pd.DataFrame({"g": np.repeat([50, 51], 12), "t": np.tile(np.arange(12.0), 2), "x": 0.1, "z": np.tile([0.0, 1.0], 12), "y": np.tile([0.0, 1.0], 12)})
    split["x"] = np.random.default_rng(4).normal(size=24) * 0.1
    both = fe_logit(spark.createDataFrame(pd.concat([people, split])), "y", ["x", "z", "t"], absorb="g")
    alone = fe_logit(spark.createDataFrame(people), "y", ["x", "t"], absorb="g")
    assert both.stats["groups_separated"] == 2 and both.aliased == ["z"] and both.stats["groups"] == alone.stats["groups"]
    assert both["x"] == pytest.approx(alone["x"], rel=1e-5) and both["t"] == pytest.approx(alone["t"], rel=1e-5)
    assert both.design.n == alone.design.n and both.df_resid == alone.df_resid
    assert both.stats["deviance"] == pytest.approx(alone.stats["deviance"], rel=1e-6)
    assert deviance_residuals(both).filter("g >= 50").count() == 0


def test_a_person_split_by_time_stays_while_others_pin_the_slope(spark, people):
    late = pd.DataFrame({"g": 60, "t": np.arange(12.0), "x": 0.0, "z": 0.0, "y": (np.arange(12) > 5).astype(float)})
    d = pd.concat([people, late], ignore_index=True)
    d = d[d.groupby("g").y.transform("nunique") > 1]
    want, _ = newton(d[["x", "t"]].to_numpy(), d.y.to_numpy(), d.g.to_numpy(), 60, True)
    fit = fe_logit(spark.createDataFrame(d), "y", ["x", "t"], absorb="g")
    assert np.allclose(fit.estimate, want[:2], rtol=1e-5) and fit.stats["groups_separated"] == 0
    only = pd.concat([late.assign(g=k) for k in range(5)])
    with pytest.raises(ValueError, match="no finite estimate"):
        fe_logit(spark.createDataFrame(only), "y", ["t"], absorb="g")


def test_a_round_removes_the_effects_of_the_one_before(spark, people):
    tables = lambda: [f for f in os.listdir(shared_dir(spark)) if f.startswith("fixed-effects")]
    before = len(tables())
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    fit = fe_logit(spark.createDataFrame(people), "y", ["x", "t"], absorb="g")
    assert len(tables()) == before + 1
    fit.release()
    assert len(tables()) == before and spark.sparkContext._jsc.getPersistentRDDs().size() <= cached


def test_the_lagged_residual_is_that_of_the_period_before(spark):
    rng = np.random.default_rng(8)
    rows = [(f"p{k}", t, float(rng.poisson(3) + 1), float(t % 3)) for k in range(6) for t in range(1, 13) if rng.uniform() < 0.7]
    rows += [("p0", 30, 2.0, 0.0), ("p0", 31, 1.0, 1.0), ("p0", 31, 4.0, 1.0), ("p0", 32, 2.0, 2.0)]
    fit = fe_poisson(spark.createDataFrame(rows, "id string, t int, y double, x double"), "y", ["x"], absorb="id")
    full = deviance_residuals(fit).toPandas().groupby(["id", "t"]).resid.mean()
    for periods in (1, 2):
        got = lagged_residual(fit, "id", "t", periods=periods).toPandas()
        assert len(got) == len(rows)
        for r in got.itertuples():
            want = full.get((r.id, r.t - periods))
            assert np.isnan(r.reslag1) if want is None else r.reslag1 == pytest.approx(want)
    plan = lagged_residual(fit, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the effects and the rows, by id
    fit.release()

"""Two absorbed sets of effects against coded dummies."""

import dense
import numpy as np
import pandas as pd
import pytest

from panelspark.models import deviance_residuals, fe_poisson, ols, predict, wls
from panelspark.models import twoway


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(5)
    g, t = (a.ravel() for a in np.meshgrid(np.arange(20), np.arange(9), indexing="ij"))
    keep = rng.uniform(size=len(g)) < 0.7
    g, t = g[keep], t[keep]
    g, t = np.concatenate([g, g[:40]]), np.concatenate([t, t[:40]])  # some cells hold several rows
    pdf = pd.DataFrame({"area": [f"a{i:02d}" for i in g], "t": t, "x1": rng.normal(size=len(g)) + 0.2 * t, "x2": rng.uniform(size=len(g)), "w": rng.uniform(0.5, 2, size=len(g))})
    pdf["fixed"] = g * 2.0  # collinear with the areas
    pdf["y"] = 0.5 * pdf.x1 - pdf.x2 + 0.3 * g + np.sin(t) + rng.normal(size=len(g))
    pdf["cnt"] = rng.poisson(np.exp(0.3 * pdf.x1 - 0.4 * pdf.x2 + 0.05 * g + 0.2 * np.sin(t))).astype(float)
    pdf["off"] = np.log(pdf.w)
    return pdf


def coded(pdf):
    return np.column_stack([pdf.x1, pdf.x2, *[(pdf.area == a).astype(float) for a in sorted(pdf.area.unique())], *[(pdf.t == t).astype(float) for t in sorted(pdf.t.unique())[1:]]])


@pytest.mark.parametrize("sets", [("area", "t"), ("t", "area")])
@pytest.mark.parametrize("weighted", [False, True])
def test_linear_equals_dummies(spark, cells, sets, weighted):
    x, w = coded(cells), cells.w.to_numpy() if weighted else None
    b, v, _ = dense.lstsq(x, cells.y.to_numpy(), w)
    df = spark.createDataFrame(cells).repartition(3)
    fit = wls(df, "y", ["x1", "fixed", "x2"], "w", absorb=sets) if weighted else ols(df, "y", ["x1", "fixed", "x2"], absorb=sets)
    assert fit.aliased == ["fixed"] and fit.df_resid == len(cells) - x.shape[1]
    assert np.allclose(fit.estimate, b[:2], rtol=1e-8) and np.allclose(fit.vcov, v[:2, :2], rtol=1e-7)


def test_poisson_equals_dummies(spark, cells):
    silent = cells.assign(cnt=0.0)
    both = pd.concat([cells, silent[:5].assign(area="zz"), silent[:7].assign(t=99)], ignore_index=True)
    x, y = coded(cells), cells.cnt.to_numpy()
    b, inv, mu = dense.poisson(x, y, cells.off.to_numpy())
    fit = fe_poisson(spark.createDataFrame(both), "cnt", ["x1", "x2"], absorb=("area", "t"), offset="off")
    assert np.allclose(fit.estimate, b[:2], rtol=1e-6, atol=1e-8)
    assert fit.df_resid == len(cells) - x.shape[1] and fit.stats["groups_dropped"] == 2
    phi = ((y - mu) ** 2 / mu).sum() / fit.df_resid
    assert np.allclose(fit.vcov, phi * inv[:2, :2], rtol=1e-5)
    got = predict(fit).toPandas().sort_values(["area", "t", "x1"])
    want = cells.assign(mu=mu).sort_values(["area", "t", "x1"])
    assert np.allclose(got.predicted, want.mu, rtol=1e-6)
    assert (deviance_residuals(fit).toPandas().resid ** 2).sum() == pytest.approx(fit.stats["deviance"], rel=1e-8)


def test_each_connected_set_costs_a_degree_of_freedom(spark):
    rng = np.random.default_rng(6)
    rows = [(f"{side}{g}", side * 10 + t, rng.normal()) for side in (1, 2, 3) for g in range(4) for t in range(3)]
    pdf = pd.DataFrame(rows, columns=["area", "t", "x"])
    pdf["y"] = pdf.x + rng.normal(size=len(pdf))
    x = np.column_stack([pdf.x, pd.get_dummies(pdf.area).to_numpy(float), pd.get_dummies(pdf.t).to_numpy(float)])
    fit = ols(spark.createDataFrame(pdf), "y", ["x"], absorb=("area", "t"))
    assert fit.df_resid == len(pdf) - np.linalg.matrix_rank(x) == len(pdf) - 1 - (12 + 9 - 3)
    assert fit["x"] == pytest.approx(np.linalg.lstsq(x, pdf.y, rcond=None)[0][0], rel=1e-8)


def test_many_areas_and_periods(spark, monkeypatch):
    """5,000 areas x 200 periods, a tenth of the cells: twice demeaned by alternating projections in numpy."""
    rng = np.random.default_rng(7)
    g, t = rng.integers(5000, size=100_000), rng.integers(200, size=100_000)
    pdf = pd.DataFrame({"g": g, "t": t, "x": rng.normal(size=100_000) + 0.01 * t})
    pdf["y"] = 0.5 * pdf.x + np.sin(g) + np.cos(t) + rng.normal(size=100_000)
    v = pdf[["x", "y"]].to_numpy()
    for _ in range(60):
        for k in (g, t):
            n = np.bincount(k)
            v = v - np.stack([(np.bincount(k, v[:, j]) / np.maximum(n, 1))[k] for j in (0, 1)], axis=1)
    df = spark.createDataFrame(pdf)
    fit = ols(df, "y", ["x"], absorb=("g", "t"))
    assert fit["x"] == pytest.approx((v[:, 0] @ v[:, 1]) / (v[:, 0] @ v[:, 0]), rel=1e-7)
    assert fit.df_resid == 100_000 - 1 - (len(np.unique(g)) + 200 - 1)
    monkeypatch.setattr(twoway, "MAX_LEVELS", 100)
    with pytest.raises(ValueError, match="over 100 levels"):
        ols(df, "y", ["x"], absorb=("g", "t"))

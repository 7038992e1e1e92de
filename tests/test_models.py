import dense
import numpy as np
import pandas as pd
import pytest

from panelspark.models import (
    Factor, Harmonic, Spline, cluster_se, deviance_residuals, fe_logit, fe_poisson, lagged_residual, ols,
    poisson_glm, predict, predict_by, vif, wls,
)
from panelspark.models import moments as mom
from panelspark.models.fit import confint
from panelspark.models.tdist import t_quantile, two_sided_p


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(12):
        effect = rng.normal()
        for t in range(1, 16 if g else 40):  # one cluster much larger than the rest
            x1, x2 = rng.normal() + 0.3 * effect, rng.uniform(0, 3)
            rows.append((f"g{g:02d}", t, "abc"[t % 3], x1, x2, 1.0 + rng.uniform(), effect))
    pdf = pd.DataFrame(rows, columns=["g", "t", "f", "x1", "x2", "w", "eff"])
    pdf["y"] = 1 + 0.5 * pdf.x1 - 0.7 * pdf.x2 + pdf.eff + rng.normal(size=len(pdf))
    pdf["cnt"] = rng.poisson(np.exp(0.4 * pdf.x1 - 0.2 * pdf.x2 + 0.5 * pdf.eff + 0.8)).astype(float)
    pdf["bin"] = (rng.uniform(size=len(pdf)) < 1 / (1 + np.exp(-(0.6 * pdf.x1 - 0.4 * pdf.x2 + pdf.eff)))).astype(float)
    pdf["off"] = np.log(pdf.w)
    return pdf, spark.createDataFrame(pdf).repartition(5).persist()


def dummies(s, base):
    return np.column_stack([(s == v).astype(float) for v in sorted(s.unique()) if v != base])


def design(pdf, groups=True):
    x = [np.ones(len(pdf)), pdf.x1, pdf.x2]
    x = np.column_stack(x + [dummies(pdf.f, "b")] + ([dummies(pdf.g, "g00")] if groups else []))
    return x


def rows_of(df):
    return {r["term"]: r for r in df.collect()}


@pytest.mark.parametrize("limit", [150, 3])
@pytest.mark.parametrize("weighted", [False, True])
def test_linear_matches_dense(panel, monkeypatch, limit, weighted):
    pdf, df = panel
    monkeypatch.setattr(mom, "MAX_SQL_SUMS", limit)
    x, w = design(pdf), pdf.w.to_numpy() if weighted else None
    b, v, e = dense.lstsq(x, pdf.y.to_numpy(), w)
    fit = ols(df, "y", ["x1", "x2", Factor("f", base="b"), Factor("g")], weights="w" if weighted else None)
    assert np.allclose(fit.estimate, b, rtol=1e-8, atol=1e-9)
    assert np.allclose(fit.vcov, v, rtol=1e-7, atol=1e-10)
    ref, dfs = dense.cr2(x, e, pdf.g.to_numpy(), w)
    got = rows_of(cluster_se(fit, "g", ["(Intercept)", "x1", "x2", "fa"]))
    for name, k in (("x1", 1), ("x2", 2), ("fa", 3)):
        assert got[name]["se"] == pytest.approx(np.sqrt(ref[k, k]), rel=1e-6)
        assert got[name]["df"] == pytest.approx(dfs[k], rel=1e-5)


def test_absorbed_linear_equals_dummies(panel):
    pdf, df = panel
    coded = ols(df, "y", ["x1", "x2", Factor("g")])
    absorbed = ols(df, "y", ["x1", "x2"], absorb="g")
    assert absorbed["x1"] == pytest.approx(coded["x1"], rel=1e-9)
    assert absorbed.df_resid == coded.df_resid
    assert np.allclose(absorbed.se, coded.se[1:3], rtol=1e-8)
    a, c = rows_of(cluster_se(absorbed, "g")), rows_of(cluster_se(coded, "g", ["x1", "x2"]))
    for name in ("x1", "x2"):
        assert a[name]["se"] == pytest.approx(c[name]["se"], rel=1e-6)
        assert a[name]["df"] == pytest.approx(c[name]["df"], rel=1e-5)
    weighted = wls(df, "y", ["x1", "x2"], "w", absorb="g")
    assert weighted["x2"] == pytest.approx(wls(df, "y", ["x1", "x2", Factor("g")], "w")["x2"], rel=1e-8)


def test_one_row_clusters_give_hc2(panel, spark):
    pdf, _ = panel
    d = pdf.assign(row=np.arange(len(pdf)))
    fit = ols(spark.createDataFrame(d), "y", ["x1", "x2"])
    x = np.column_stack([np.ones(len(d)), d.x1, d.x2])
    _, _, e = dense.lstsq(x, d.y.to_numpy())
    m = np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, m, x)
    hc2 = m @ ((x * (e**2 / (1 - h))[:, None]).T @ x) @ m
    got = rows_of(cluster_se(fit, "row"))
    assert got["x1"]["se"] == pytest.approx(np.sqrt(hc2[1, 1]), rel=1e-7)


def test_aliased_columns_are_dropped_in_term_order(spark):
    pdf = pd.DataFrame([(a, t, float(a == "p"), float(t > 2)) for a in "pqr" for t in range(5)], columns=["a", "t", "e", "post"])
    rng = np.random.default_rng(1)
    pdf["y"] = rng.normal(size=len(pdf)) + pdf.e * pdf.post * 3
    pdf["did"] = pdf.e * pdf.post
    fit = ols(spark.createDataFrame(pdf), "y", ["post", "e", "did", Factor("a")])
    assert fit.aliased == ["ar"] or fit.aliased == ["aq"]
    table = rows_of(fit.table())
    assert table[fit.aliased[0]]["estimate"] is None
    cell = pdf.groupby(["e", "post"]).y.mean()
    assert fit["did"] == pytest.approx((cell[1, 1] - cell[1, 0]) - (cell[0, 1] - cell[0, 0]), rel=1e-9)


@pytest.mark.parametrize("limit", [150, 3])
def test_poisson_matches_dense(panel, monkeypatch, limit):
    pdf, df = panel
    monkeypatch.setattr(mom, "MAX_SQL_SUMS", limit)
    x = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2, dummies(pdf.g, "g00")])
    y = pdf.cnt.to_numpy()
    b, inv, mu = dense.poisson(x, y, pdf.off.to_numpy())
    fit = poisson_glm(df, "cnt", ["x1", "x2", Factor("g")], offset="off")
    assert np.allclose(fit.estimate, b, rtol=1e-7, atol=1e-8)
    phi = ((y - mu) ** 2 / mu).sum() / (len(y) - x.shape[1])
    assert fit.dispersion == pytest.approx(phi, rel=1e-8)
    assert np.allclose(fit.vcov, phi * inv, rtol=1e-6, atol=1e-9)
    ref, dfs = dense.cr2(x * mu[:, None], y - mu, pdf.g.to_numpy(), 1 / mu, mu)
    got = rows_of(cluster_se(fit, "g", ["x1", "x2"]))
    assert got["x1"]["se"] == pytest.approx(np.sqrt(ref[1, 1]), rel=1e-6)
    assert got["x2"]["df"] == pytest.approx(dfs[2], rel=1e-5)


@pytest.mark.parametrize("limit", [150, 2])
def test_absorbed_poisson(panel, monkeypatch, spark, limit):
    pdf, df = panel
    monkeypatch.setattr(mom, "MAX_SQL_SUMS", limit)
    silent = pd.DataFrame({"g": ["zz"] * 3, "t": [1, 2, 3], "x1": [0.1, 0.2, 0.9], "x2": [1.0, 2.0, 0.5], "cnt": [0.0] * 3})
    both = df.select("g", "t", "x1", "x2", "cnt").union(spark.createDataFrame(silent))
    x = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2, dummies(pdf.g, "g00")])
    b, inv, mu = dense.poisson(x, pdf.cnt.to_numpy())
    fit = fe_poisson(both, "cnt", ["x1", "x2"], absorb="g")
    assert np.allclose(fit.estimate, b[1:3], rtol=1e-7)
    phi = ((pdf.cnt - mu) ** 2 / mu).sum() / (len(pdf) - x.shape[1])
    assert np.allclose(fit.vcov, phi * inv[1:3, 1:3], rtol=1e-6)
    assert fit.stats["groups_dropped"] == 1 and fit.design.n == len(pdf)
    got = predict(fit).toPandas().sort_values(["g", "t"])
    assert np.allclose(got.predicted, pd.Series(mu).to_numpy(), rtol=1e-7)
    r = deviance_residuals(fit).toPandas()
    assert (r.resid**2).sum() == pytest.approx(fit.stats["deviance"], rel=1e-9)


@pytest.mark.parametrize("limit", [150, 3])
def test_absorbed_logit(panel, monkeypatch, spark, limit):
    pdf, df = panel
    monkeypatch.setattr(mom, "MAX_SQL_SUMS", limit)
    flat = pd.DataFrame({"g": ["zz"] * 3, "t": [1, 2, 3], "x1": [0.1, 0.2, 0.9], "x2": [1.0, 2.0, 0.5], "bin": [1.0] * 3})
    both = df.select("g", "t", "x1", "x2", "bin").union(spark.createDataFrame(flat))
    use = pdf.groupby("g").bin.transform("nunique") > 1
    d = pdf[use]
    x = np.column_stack([d.x1, d.x2] + [(d.g == v).astype(float) for v in sorted(d.g.unique())])
    b, inv, p = dense.logit(x, d.bin.to_numpy())
    fit = fe_logit(both, "bin", ["x1", "x2"], absorb="g")
    assert np.allclose(fit.estimate, b[:2], rtol=1e-6)
    assert np.allclose(fit.vcov, inv[:2, :2], rtol=1e-5)
    assert fit.stats["groups_dropped"] == 1 + (12 - d.g.nunique())
    assert (deviance_residuals(fit).toPandas().resid ** 2).sum() == pytest.approx(fit.stats["deviance"], rel=1e-8)


def test_autocorrelation_refit_never_crosses_ids(panel):
    pdf, df = panel
    first = fe_poisson(df, "cnt", ["x1"], absorb="g")
    lagged = lagged_residual(first, "g", "t").toPandas()
    full = deviance_residuals(first).toPandas().set_index(["g", "t"]).resid
    for r in lagged.itertuples():
        if r.t == 1:
            assert np.isnan(r.reslag1)
        else:
            assert r.reslag1 == pytest.approx(full[r.g, r.t - 1])
    second = fe_poisson(lagged_residual(first, "g", "t"), "cnt", ["x1", "reslag1"], absorb="g")
    assert second.design.n == len(pdf) - pdf.g.nunique()
    assert {r["term"] for r in second.table().collect()} == {"x1", "reslag1"}
    means = predict_by(first, ["g"]).toPandas()
    assert np.allclose(means.mean_predicted, means.mean_observed)  # each effect fits its group's total


def test_spline_spans_the_natural_cubic_space(panel):
    pdf, df = panel
    fit = ols(df, "y", [Spline("x2", 2), Harmonic("t", 2, 12)])
    k = np.quantile(pdf.x2, [0, 0.5, 1])
    pos = lambda z: np.maximum(z, 0) ** 3
    d = lambda a: (pos(pdf.x2 - a) - pos(pdf.x2 - k[2])) / (k[2] - a)
    ang = [2 * np.pi * j * pdf.t / 12 for j in (1, 2)]
    x = np.column_stack([np.ones(len(pdf)), pdf.x2, d(k[0]) - d(k[1]), *map(np.sin, ang), *map(np.cos, ang)])
    _, _, e = dense.lstsq(x, pdf.y.to_numpy())
    assert fit.stats["rss"] == pytest.approx((e**2).sum(), rel=1e-9)
    assert np.allclose(fit.estimate[-4:], dense.lstsq(x, pdf.y.to_numpy())[0][-4:], rtol=1e-7)


def test_tail_areas_and_intervals(panel, spark):
    assert two_sided_p(2.0, 10.0) == pytest.approx(0.07338803477074, rel=1e-9)
    assert two_sided_p(1.0, 1.0) == pytest.approx(0.5, rel=1e-12)
    assert two_sided_p(1.959963984540054, None) == pytest.approx(0.05, rel=1e-9)
    assert t_quantile(0.95, 4.0) == pytest.approx(2.7764451051978, rel=1e-9)
    _, df = panel
    fit = ols(df, "y", ["x1"])
    r = rows_of(confint(fit.table()))["x1"]
    assert (r["low"] + r["high"]) / 2 == pytest.approx(fit["x1"])
    assert r["high"] - r["low"] == pytest.approx(2 * t_quantile(0.95, fit.df_resid) * fit.se[1])


def test_vif_of_two_columns(panel):
    pdf, df = panel
    r = np.corrcoef(pdf.x1, pdf.x2)[0, 1]
    for row in vif(df, ["x1", "x2"]).collect():
        assert row["vif"] == pytest.approx(1 / (1 - r * r), rel=1e-9)


def test_scaling_and_partitioning_do_not_change_the_fit(panel):
    pdf, df = panel
    a = ols(df, "y", ["x1", "x2"], weights="w")
    b = ols(df.repartition(13).withColumn("y", df.y * 1000.0), "y", ["x1", "x2"], weights="w")
    assert np.allclose(b.estimate, 1000 * a.estimate, rtol=1e-9)
    sums = a.summary().toPandas().set_index("name").value
    x = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    coef, _, e = dense.lstsq(x, pdf.y.to_numpy(), pdf.w.to_numpy())
    w = pdf.w.to_numpy()
    assert sums["sigma"] == pytest.approx(np.sqrt((w * e * e).sum() / (len(w) - 3)), rel=1e-9)
    ybar = (w * pdf.y).sum() / w.sum()
    assert sums["r2"] == pytest.approx(1 - (w * e * e).sum() / (w * (pdf.y - ybar) ** 2).sum(), rel=1e-9)


def test_hot_groups_are_cut_into_parts(spark, monkeypatch):
    from panelspark.models import spread as sp

    rng = np.random.default_rng(5)
    g = np.where(np.arange(12000) % 3 == 0, "hot", [f"g{i % 300}" for i in range(12000)])
    pdf = pd.DataFrame({"g": g, "x": rng.normal(size=12000)})
    pdf["c"] = rng.poisson(np.exp(0.3 * pdf.x + 0.5)).astype(float)
    pdf["b"] = (rng.uniform(size=12000) < 1 / (1 + np.exp(-0.5 * pdf.x))).astype(float)
    df = spark.createDataFrame(pdf)
    cut = sp.spread_rows(df, "g", 12000)
    assert cut.hot == ["hot"]
    sizes = cut.rows.filter("g = 'hot'").groupBy("__part").count().toPandas()
    assert len(sizes) == cut.parts and sizes["count"].max() < 2 * 4000 / cut.parts
    cut.release()
    split = [fe_poisson(df, "c", ["x"], absorb="g"), fe_logit(df, "b", ["x"], absorb="g")]
    monkeypatch.setattr(sp, "spread_rows", lambda d, key, n: sp.Spread(d, key, [], 2))
    import panelspark.models.fixed as fixed

    monkeypatch.setattr(fixed, "spread_rows", sp.spread_rows)
    whole = [fe_poisson(df, "c", ["x"], absorb="g"), fe_logit(df, "b", ["x"], absorb="g")]
    for a, b in zip(split, whole):
        assert a["x"] == pytest.approx(b["x"], rel=1e-9)
        assert np.allclose(a.se, b.se, rtol=1e-6)

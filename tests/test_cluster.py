"""CR2 errors with absorbed effects, either working covariance and missing clusters, against row-level matrices."""

import dense
import numpy as np
import pandas as pd
import pytest

from panelspark.models import Factor, cluster_se, fe_poisson, ols, poisson_glm, wls


@pytest.fixture(scope="module")
def areas(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(25):
        effect = rng.normal(scale=0.6)
        for t in range(8 if g % 5 else 14):
            rows.append((f"g{g:02d}", f"r{g // 3}", rng.normal() + 0.3 * effect, rng.uniform(0, 2), rng.uniform(0.3, 3), effect))
    pdf = pd.DataFrame(rows, columns=["g", "region", "x1", "x2", "w", "eff"])
    pdf["y"] = 0.5 * pdf.x1 - 0.7 * pdf.x2 + pdf.eff + rng.normal(size=len(pdf)) / np.sqrt(pdf.w)
    pdf["cnt"] = rng.poisson(np.exp(0.4 * pdf.x1 - 0.2 * pdf.x2 + pdf.eff + 0.8)).astype(float)
    pdf["off"] = np.log(pdf.w)
    return pdf, spark.createDataFrame(pdf).repartition(4).persist()


def coded(pdf):
    return np.column_stack([pdf.x1, pdf.x2, *[(pdf.g == v).astype(float) for v in sorted(pdf.g.unique())]])


def same(table, ref, dfs, rel=1e-6):
    got = {r["term"]: r for r in table.collect()}
    for k, name in enumerate(["x1", "x2"]):
        assert got[name]["se"] == pytest.approx(np.sqrt(ref[k, k]), rel=rel)
        assert got[name]["df"] == pytest.approx(dfs[k], rel=rel)


@pytest.mark.parametrize("working", ["identity", "model"])
@pytest.mark.parametrize("absorb", [True, False])
def test_weighted_least_squares(areas, absorb, working):
    pdf, df = areas
    x, y, w = coded(pdf), pdf.y.to_numpy(), pdf.w.to_numpy()
    _, _, e = dense.lstsq(x, y, w)
    ref, dfs = dense.cr2(x, e, pdf.g.to_numpy(), w, None if working == "identity" else 1 / w)
    fit = wls(df, "y", ["x1", "x2"], "w", absorb="g") if absorb else wls(df, "y", ["x1", "x2", Factor("g")], "w")
    same(cluster_se(fit, "g", ["x1", "x2"], working), ref, dfs)
    if working == "identity":
        same(cluster_se(fit, "g", ["x1", "x2"]), ref, dfs)


@pytest.mark.parametrize("working", ["identity", "model"])
@pytest.mark.parametrize("absorb", [True, False])
def test_poisson(areas, absorb, working):
    pdf, df = areas
    x, y = coded(pdf), pdf.cnt.to_numpy()
    _, _, mu = dense.poisson(x, y, pdf.off.to_numpy())
    ref, dfs = dense.cr2(x * mu[:, None], y - mu, pdf.g.to_numpy(), 1 / mu, mu if working == "model" else None)
    fit = fe_poisson(df, "cnt", ["x1", "x2"], absorb="g", offset="off") if absorb else poisson_glm(df, "cnt", ["x1", "x2", Factor("g")], offset="off")
    same(cluster_se(fit, "g", ["x1", "x2"], working), ref, dfs, 1e-5)
    if working == "model":
        same(cluster_se(fit, "g", ["x1", "x2"]), ref, dfs, 1e-5)


def test_clusters_of_whole_absorbed_groups(areas):
    pdf, df = areas
    x, y, c = coded(pdf), pdf.y.to_numpy(), pdf.region.to_numpy()
    _, _, e = dense.lstsq(x, y)
    same(cluster_se(ols(df, "y", ["x1", "x2"], absorb="g"), "region"), *dense.cr2(x, e, c))
    _, _, mu = dense.poisson(x, pdf.cnt.to_numpy())
    same(cluster_se(fe_poisson(df, "cnt", ["x1", "x2"], absorb="g"), "region"), *dense.cr2(x * mu[:, None], pdf.cnt.to_numpy() - mu, c, 1 / mu, mu), 1e-5)
    with pytest.raises(ValueError, match="in one cluster"):
        cluster_se(ols(df, "y", ["x1", "x2"], absorb="region"), "g")
    with pytest.raises(ValueError, match="must be the absorbed"):
        cluster_se(wls(df, "y", ["x1", "x2"], "w", absorb="g"), "region")


def test_rows_without_a_cluster_are_left_out_of_the_fit(areas, spark):
    pdf, _ = areas
    some = pdf.assign(c=np.where(np.arange(len(pdf)) % 10 == 0, None, pdf.region))
    kept = pdf[some.c.notna()]
    x = np.column_stack([kept.x1, kept.x2, np.ones(len(kept))])
    _, _, e = dense.lstsq(x, kept.y.to_numpy())
    same(cluster_se(ols(spark.createDataFrame(some), "y", ["x1", "x2"]), "c"), *dense.cr2(x, e, kept.region.to_numpy()))
    gap = pdf.assign(c=np.where(np.arange(len(pdf)) % 10 == 0, np.nan, pdf.g.str[1:].astype(float)))
    x = coded(kept)
    _, _, mu = dense.poisson(x, kept.cnt.to_numpy())
    fit = poisson_glm(spark.createDataFrame(gap), "cnt", ["x1", "x2", Factor("g")])
    same(cluster_se(fit, "c", ["x1", "x2"]), *dense.cr2(x * mu[:, None], kept.cnt.to_numpy() - mu, kept.g.to_numpy(), 1 / mu, mu), 1e-5)


def test_thousands_of_areas(spark):
    """Far beyond what coded dummies could hold; effects of areas nested in clusters leave the plain within-area formula."""
    rng = np.random.default_rng(2)
    g = np.repeat(np.arange(5000), 3)
    pdf = pd.DataFrame({"g": g, "x": rng.normal(size=len(g)), "w": rng.uniform(0.5, 2, size=len(g))})
    pdf["y"] = pdf.x + rng.normal(size=len(g))
    pdf["cnt"] = rng.poisson(np.exp(0.3 * pdf.x + 0.7)).astype(float)
    df = spark.createDataFrame(pdf)
    fit = ols(df, "y", ["x"], absorb="g")
    (got,) = cluster_se(fit, "g").collect()
    xd, yd = (pdf[c] - pdf.groupby("g")[c].transform("mean") for c in ("x", "y"))
    m = 1 / (xd @ xd)
    score = (xd * (yd - xd * fit["x"])).groupby(g).sum() / np.sqrt(1 - m * (xd * xd).groupby(g).sum())
    assert got["se"] == pytest.approx(m * np.sqrt((score**2).sum()), rel=1e-8)
    for fit in (wls(df, "y", ["x"], "w", absorb="g"), fe_poisson(df, "cnt", ["x"], absorb="g")):
        (got,) = cluster_se(fit, "g").collect()
        assert 0.5 * fit.se[0] < got["se"] < 2 * fit.se[0] and 1000 < got["df"] < 5000

"""Cluster-robust errors with the bias-reduced (CR2) correction and Satterthwaite degrees of freedom.

The correction of a cluster is a matrix root of its rows' size. Because the matrix is the identity plus a low-rank part
built from the design, everything it is used for depends on the cluster only through coefficient-sized cross products.
Those are plain sums per cluster, so a cluster may hold any share of the rows. Each cluster is then one row, and only sums
over clusters reach the driver.

With Q the cluster's columns, G = I + Q K Q' and f the (pseudo-)inverse root,
Q' f(G) e = R f(I + R'KR) R^+ Q'e for any R with R R' = Q'Q.

Absorbed effects never become columns. Rows are put on a scale where an effect's column is `__d`; taking it out of the
cross products of its group (a Schur complement of the group's sums) leaves what coded dummies would leave. Where weights
are not the inverse of the working variance, the effect's column and its weighted copy stay in Q, two columns a cluster,
with a K of the cluster's own; between clusters they only act through the slopes' columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .design import linear_predictor, present
from .fit import TABLE_SCHEMA, Fit
from .moments import moments, sum_vectors, symmetric, triangle_at
from .tdist import two_sided_p

ROOT_TOL = 1e-8
WORKING = ("default", "identity", "model")


def _working_rows(fit: Fit, cluster: str, working: str) -> tuple[DataFrame, bool]:
    """Columns `__cl` (and the absorbed group), `__q<i>`, `__d`, `__v`, `__e` on the scale where the working variance is one,
    and whether `__v`, the weights there, differ from one."""
    d, x = fit.design, fit.xcols
    eta = linear_predictor(x, fit.coef)
    data = d.data
    model = working == "model" or working == "default" and fit.family == "poisson"
    one = F.lit(1.0)
    if fit.family == "gaussian":
        e, scale, weight = F.col("__y") - eta, F.sqrt("__w") if model else one, one if model else F.col("__w")
        e = e * scale
        varies = d.weighted and not model
    elif fit.absorb is None or not model:
        if fit.absorb is not None:
            data, eta = data.join(fit.effects, fit.absorb), eta + F.col("__alpha")
        mu = F.exp(eta + F.col("__off"))
        scale, weight = (F.sqrt(mu), one) if model else (mu, 1 / mu)
        e = (F.col("__y") - mu) / (F.sqrt(mu) if model else 1.0)
        varies = not model
    else:
        # mu is the group's factor times this; the factor is a ratio of sums that the group's cross products hold
        part = F.exp(eta + F.col("__off"))
        scale, weight, e, varies = F.sqrt(part), one, F.col("__y") / F.sqrt(part), False
    keys = [F.col(cluster).alias("__cl"), *([F.col(fit.absorb).alias("__g")] if fit.absorb else [])]
    q = [(F.col(c) * scale).alias(f"__q{i}") for i, c in enumerate(x)]
    return data.select(*keys, *q, scale.alias("__d"), weight.alias("__v"), e.alias("__e")), varies


def _taken_out(groups: DataFrame, k: int, factor: bool) -> DataFrame:
    """`m` for the columns after the first one, whose share is taken out; with `factor`, of a Poisson group that is scaled
    by the sum of its outcome over that of its unscaled means."""
    at = lambda i, j: f"m[{triangle_at(i, j, k)}]"
    left = lambda i, j: f"{at(i, j)} - {at(0, i)} * {at(0, j)} / m[0]"
    s = f"{at(0, k - 1)} / m[0] * "
    within = [f"{s if factor and j < k - 1 else ''}({left(i, j)})" for i in range(1, k) for j in range(i, k)]
    groups = groups.filter(f"{at(0, k - 1)} > 0" if factor else "m[0] > 0")
    return groups.withColumn("m", F.expr(f"array({', '.join(within)})"))


def _cluster_moments(fit: Fit, cluster: str, working: str) -> tuple[DataFrame, bool]:
    """(__cl, m): upper triangle of the cross products of a cluster's columns, and whether rows have weights of their own.

    The columns are Q and e; with weights [Q, vQ, e], and with absorbed effects under weights [d, Q, vd, vQ, e].
    """
    rows, varies = _working_rows(fit, cluster, working)
    q = [f"__q{i}" for i in range(len(fit.kept))]
    if varies:
        whole = [*(["__d"] if fit.absorb else []), *q]
        rows = rows.select("*", *[(F.col(c) * F.col("__v")).alias(f"__v{c}") for c in whole])
        columns = [*whole, *[f"__v{c}" for c in whole], "__e"]
        if fit.absorb and cluster != fit.absorb:
            raise ValueError("with absorbed effects and weights, clusters must be the absorbed groups")
        return moments(rows, columns, by=["__cl"]), True
    if fit.absorb is None:
        return moments(rows, [*q, "__e"], by=["__cl"]), False
    factor = fit.family == "poisson" and working != "identity"
    if cluster == fit.absorb:
        return _taken_out(moments(rows, ["__d", *q, "__e"], by=["__cl"]), len(q) + 2, factor).select("__cl", "m"), False
    groups = moments(rows, ["__d", *q, "__e"], by=["__cl", "__g"])
    split = groups.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not split.isEmpty():
        raise ValueError("every absorbed group must lie in one cluster")
    return sum_vectors(_taken_out(groups, len(q) + 2, factor), "m", ["__cl"]), False


def _own_columns(full: np.ndarray, p: int) -> np.ndarray:
    """From cross products of [d, Q, vd, vQ, e] to those of [Q, d, vQ, vd, e], d's (weighted) share taken out of Q, vQ and e."""
    n = 2 * p + 3
    share = full[0, p + 1 :] / full[0, p + 1]  # of d in vd, vQ, e: d'vd, d'vQ; e is treated below
    t = np.zeros((n, n))
    for i in range(p):
        t[1 + i, i], t[0, i] = 1.0, -share[1 + i]
        t[p + 2 + i, p + 1 + i], t[p + 1, p + 1 + i] = 1.0, -share[1 + i]
    t[0, p] = t[p + 1, 2 * p + 1] = t[n - 1, n - 1] = 1.0
    t[0, n - 1] = -full[p + 1, n - 1] / full[0, p + 1]
    return t.T @ full @ t


def cluster_se(fit: Fit, cluster: str, terms: Sequence[str] | None = None, working: str = "default") -> DataFrame:
    """CR2 t-tests (term, estimate, se, stat, df, p).

    `working` is the covariance that the correction takes for granted: "identity", or "model", the variance that the fit's
    weights imply (the inverse of the weights, or the Poisson mean), its root taken on the scale where it is one. The
    default is the identity for (weighted) linear models and the model's variance for Poisson models.

    With absorbed effects, clusters are the absorbed groups or, where the fit's weights are those of the working variance,
    any sets of whole groups. Rows without a cluster are left out: the model is then fitted again without them.
    """
    if working not in WORKING:
        raise ValueError(f"working is one of {', '.join(WORKING)}")
    if fit.family == "binomial" or isinstance(fit.absorb, (list, tuple)):
        raise ValueError("cluster errors cover linear and Poisson models with at most one absorbed set")
    per_cluster, varies = _cluster_moments(fit, cluster, working)
    per_cluster = per_cluster.persist()
    try:
        if not per_cluster.filter(~present(per_cluster, "__cl")).isEmpty():
            again = fit.refit(cluster)
            try:
                return cluster_se(again, cluster, terms, working)
            finally:
                again.release()
        return _tests(fit, per_cluster, varies, terms)
    finally:
        per_cluster.unpersist()


def _tests(fit: Fit, per_cluster: DataFrame, varies: bool, terms: Sequence[str] | None) -> DataFrame:
    p = len(fit.kept)
    bread = fit.bread
    own = varies and fit.absorb is not None
    names = [t for t in (terms or fit.terms) if t in fit.terms]
    if not names:
        raise ValueError("none of the terms was estimated")
    loads = bread @ fit.back[[fit.terms.index(t) for t in names]].T  # p x terms
    q = 2 * p if varies else p
    if not varies:
        k_mat = -bread
    else:
        width = 2 * p + 3 if own else q + 1

        def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((p, p))
            for pdf in batches:
                for vec in pdf["m"]:
                    full = symmetric(vec, width)
                    total += _own_columns(full, p)[p + 1 : 2 * p + 1, p + 1 : 2 * p + 1] if own else full[p:q, p:q]
            yield pd.DataFrame({"m": [total.ravel().tolist()]})

        parts = per_cluster.select("m").mapInPandas(outer, "m array<double>")
        middle = bread @ np.asarray(sum_vectors(parts, "m").head()["m"], dtype=float).reshape(p, p) @ bread
        k_mat = np.block([[middle, -bread], [-bread, np.zeros((p, p))]])

    def columns(vec) -> tuple[np.ndarray, np.ndarray, np.ndarray, slice]:
        """Cross products of the cluster's columns, those with e, its K, and where the columns of the scores are."""
        if not own:
            full = symmetric(vec, q + 1)
            return full[:q, :q], full[:q, q], k_mat, slice(q - p, q)
        full = _own_columns(symmetric(vec, width), p)
        cross, (total, square) = full[p + 1 : 2 * p + 1, 2 * p + 1], (full[p, 2 * p + 1], full[2 * p + 1, 2 * p + 1])
        k = np.zeros((q + 2, q + 2))
        k[:p, :p], k[:p, p + 1 : 2 * p + 1] = middle, -bread
        k[:p, p], k[p, 2 * p + 1] = bread @ cross / total, -1.0 / total
        k = k + k.T
        k[:p, :p] /= 2
        k[p, p] = square / total**2
        return full[:-1, :-1], full[:-1, -1], k, slice(p + 1, 2 * p + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nt = len(names)
        meat, b, s2, cross, trace = np.zeros((p, p)), np.zeros((nt, q, q)), np.zeros(nt), np.zeros(nt), np.zeros(nt)
        for pdf in batches:
            for vec in pdf["m"]:
                gram, with_e, k, at = columns(vec)
                lam, v = np.linalg.eigh(gram)
                use = lam > 1e-12 * max(lam[-1], 0.0)
                if not use.any():
                    continue
                root, inv_root = v[:, use] * np.sqrt(lam[use]), v[:, use] / np.sqrt(lam[use])
                core = np.eye(use.sum()) + root.T @ k @ root
                g, u = np.linalg.eigh((core + core.T) / 2)
                f = (u * np.where(g > ROOT_TOL, 1.0 / np.sqrt(np.maximum(g, ROOT_TOL)), 0.0)) @ u.T
                score = (root @ (f @ (inv_root.T @ with_e)))[at]
                meat += np.outer(score, score)
                fz = f @ (root[at].T @ loads)
                qs = root @ fz  # columns x terms
                s = (fz * fz).sum(axis=0)
                quad = np.einsum("it,ij,jt->t", qs, k, qs)
                if own:
                    # what another cluster meets: the effect acts through the slopes' weighted columns
                    met = np.vstack([qs[:p], qs[p + 1 : 2 * p + 1] - np.outer(gram[p + 1 : 2 * p + 1, 2 * p + 1], qs[p]) / gram[p, 2 * p + 1]])
                    shared = np.einsum("it,ij,jt->t", met, k_mat, met)
                    qs, s, quad = met, s + quad - shared, shared
                b += np.einsum("it,jt->tij", qs, qs)
                s2 += s * s
                cross += s * quad
                trace += s + quad
        yield pd.DataFrame({"m": [np.concatenate([meat.ravel(), b.ravel(), s2, cross, trace]).tolist()]})

    parts = per_cluster.select("m").mapInPandas(run, "m array<double>")
    flat = np.asarray(sum_vectors(parts, "m").head()["m"], dtype=float)
    nt = len(names)
    sizes = [p * p, nt * q * q, nt, nt, nt]
    meat, b, s2, cross, trace = np.split(flat, np.cumsum(sizes)[:-1])
    meat, b = meat.reshape(p, p), b.reshape(nt, q, q)
    rows = []
    for t, name in enumerate(names):
        var = float(loads[:, t] @ meat @ loads[:, t])
        kb = k_mat @ b[t]
        spread = float(s2[t] + 2 * cross[t] + np.sum(kb * kb.T))
        df = float(trace[t] ** 2 / spread) if spread > 0 else None
        se, est = float(np.sqrt(max(var, 0.0))), fit[name]
        stat = est / se if se > 0 and df is not None else None
        rows.append((name, est, se, stat, df, None if stat is None else two_sided_p(stat, df)))
    return fit.spark.createDataFrame(rows, TABLE_SCHEMA)

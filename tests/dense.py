"""Independent dense numpy solutions that the distributed estimators are checked against."""

import numpy as np


def lstsq(x, y, w=None):
    w = np.ones(len(y)) if w is None else w
    xtwx = (x * w[:, None]).T @ x
    b = np.linalg.solve(xtwx, (x * w[:, None]).T @ y)
    e = y - x @ b
    s2 = (w * e * e).sum() / (len(y) - x.shape[1])
    return b, s2 * np.linalg.inv(xtwx), e


def sym_root(a):
    g, u = np.linalg.eigh((a + a.T) / 2)
    return (u * np.where(g > 1e-9, 1 / np.sqrt(np.maximum(g, 1e-9)), 0)) @ u.T


def cr2(x, e, cl, w=None, phi=None, invert=True):
    """Row-level CR2: covariance and Satterthwaite df, from n x n matrices.

    `phi` is the diagonal working variance; `invert=True` says w = 1/phi. The root is taken on the
    scale where phi is one.
    """
    n, p = x.shape
    w = np.ones(n) if w is None else w
    phi = np.ones(n) if phi is None else phi
    m = np.linalg.inv((x * w[:, None]).T @ x)
    h = x @ m @ (x * w[:, None]).T
    v = (np.eye(n) - h) @ np.diag(phi) @ (np.eye(n) - h).T
    half = np.sqrt(phi)
    meat, es = np.zeros((p, p)), []
    for c in np.unique(cl):
        j = np.where(cl == c)[0]
        g = v[np.ix_(j, j)] / np.outer(half[j], half[j])
        a = half[j][:, None] * sym_root(g) / half[j][None, :]
        xw = x[j] * w[j][:, None]
        s = xw.T @ a @ e[j]
        meat += np.outer(s, s)
        full = np.zeros((n, p))
        full[j] = a.T @ xw @ m
        es.append(full)
    dfs = []
    for k in range(p):
        ek = np.stack([f[:, k] for f in es], axis=1)
        pm = ek.T @ v @ ek
        dfs.append(np.trace(pm) ** 2 / (pm * pm).sum())
    return m @ meat @ m, np.array(dfs)


def poisson(x, y, off=None, rounds=60):
    off = np.zeros(len(y)) if off is None else off
    eta = np.log(y + 0.1)
    for _ in range(rounds):
        mu = np.exp(eta)
        z = eta - off + (y - mu) / mu
        b = np.linalg.solve((x * mu[:, None]).T @ x, (x * mu[:, None]).T @ z)
        eta = x @ b + off
    mu = np.exp(eta)
    return b, np.linalg.inv((x * mu[:, None]).T @ x), mu


def logit(x, y, rounds=60):
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ b)))
        v = p * (1 - p)
        b = b + np.linalg.solve((x * v[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-(x @ b)))
    return b, np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x), p

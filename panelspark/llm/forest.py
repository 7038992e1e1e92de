"""A small random forest in numpy: grown on the driver from a bounded table, used on arrays inside tasks."""

from __future__ import annotations

import numpy as np

TREES = 40
DEPTH = 9
LEAST_LEAF = 3
CUTS = 24


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[int, float] | None:
    """Column and threshold with the least Gini impurity among quantile cuts."""
    best, at = len(y) * y.mean() * (1 - y.mean()) - 1e-9, None
    for c in columns.tolist():
        cuts = np.unique(np.quantile(x[:, c], np.linspace(0.02, 0.98, CUTS)))
        left = x[:, c, None] <= cuts
        n = left.sum(0)
        ones = (left & (y[:, None] > 0)).sum(0)
        m, more = len(y) - n, y.sum() - ones
        fits = (n >= LEAST_LEAF) & (m >= LEAST_LEAF)
        cost = np.where(fits, ones * (1 - ones / np.maximum(n, 1)) + more * (1 - more / np.maximum(m, 1)), np.inf)
        i = int(cost.argmin())
        if cost[i] < best:
            best, at = cost[i], (c, float(cuts[i]))
    return at


def grow(x: np.ndarray, y: np.ndarray, seed: int, trees: int = TREES, depth: int = DEPTH) -> list[np.ndarray]:
    """Trees as arrays of rows (column or -1, threshold, left, right, share of ones)."""
    rng = np.random.default_rng(seed)
    width = max(1, int(np.sqrt(x.shape[1])) + 1)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        nodes: list[list[float]] = []

        def add(own: np.ndarray, left: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[own].mean())])
            if left and 0 < y[own].mean() < 1 and len(own) >= 2 * LEAST_LEAF:
                found = _split(x[own], y[own], rng.permutation(x.shape[1])[:width])
                if found:
                    low = x[own, found[0]] <= found[1]
                    a, b = add(own[low], left - 1), add(own[~low], left - 1)
                    nodes[at][:4] = [found[0], found[1], a, b]
            return at

        add(rows, depth)
        forest.append(np.array(nodes))
    return forest


def share(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean share of ones over the trees, for each row of x."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for tree in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            column = tree[at, 0].astype(np.int64)
            inner = column >= 0
            if not inner.any():
                break
            low = x[rows, np.maximum(column, 0)] <= tree[at, 1]
            at = np.where(inner, np.where(low, tree[at, 2], tree[at, 3]).astype(np.int64), at)
        total += tree[at, 4]
    return total / len(forest)

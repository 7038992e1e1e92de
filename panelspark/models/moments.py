"""Weighted cross-product sums, per group or overall.

Layout of a moment vector for columns c_0..c_{k-1}: the upper triangle of sum(w * c_i * c_j), row by
row, then the plain sums of any extra columns. Narrow designs are one SQL aggregation; wide ones
take partial products per Arrow batch with numpy and let Spark add the vectors up. Both combine
before the shuffle, so the size of a group does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SQL_SUMS = 150
_MAX_HELD = 4_000_000  # doubles one task holds before it emits its partial sums


def triangle_pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def triangle_at(i: int, j: int, k: int) -> int:
    i, j = min(i, j), max(i, j)
    return i * k - i * (i - 1) // 2 + (j - i)


def symmetric(m, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    rows, cols = np.triu_indices(k)
    out[rows, cols] = np.asarray(m[: len(rows)], dtype=float)
    out[cols, rows] = out[rows, cols]
    return out


def moments(df: DataFrame, cols: Sequence[str], weight: str | None = None, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """One row per group (or one in all): `by`, `m`."""
    keys = list(by)
    pairs = triangle_pairs(len(cols))
    if len(pairs) + len(extra) <= MAX_SQL_SUMS:
        # One parsed expression: building hundreds of Column objects costs more than the sums.
        w = f" * `{weight}`" if weight else ""
        sums = [f"sum(`{cols[i]}` * `{cols[j]}`{w})" for i, j in pairs] + [f"sum(`{c}`)" for c in extra]
        return df.groupBy(*keys).agg(F.expr(f"array({', '.join(sums)})").alias("m"))
    parts = _partial_products(df, list(cols), weight, keys, list(extra))
    return sum_vectors(parts, "m", keys)


def sum_vectors(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Element-wise sum of an array<double> column, per key."""
    total = Summarizer.sum(array_to_vector(F.col(col)))
    return df.groupBy(*keys).agg(vector_to_array(total).alias(col))


def _partial_products(df: DataFrame, cols: list[str], weight: str | None, by: list[str], extra: list[str]) -> DataFrame:
    k = len(cols)
    width = k * (k + 1) // 2 + len(extra)
    held = max(1, _MAX_HELD // width)
    names = by + list(dict.fromkeys([*cols, *([weight] if weight else []), *extra]))
    fields = [T.StructField(b, df.schema[b].dataType) for b in by] + [T.StructField("m", T.ArrayType(T.DoubleType()))]

    def emit(acc: dict) -> pd.DataFrame:
        out = {b: [key[i] for key in acc] for i, b in enumerate(by)}
        out["m"] = [v.tolist() for v in acc.values()]
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(k)
        acc: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = pdf[cols].to_numpy(dtype=float)
            wx = x * pdf[weight].to_numpy(dtype=float)[:, None] if weight else x
            ex = pdf[extra].to_numpy(dtype=float)
            if by:
                grouped = pdf.groupby(by, sort=False, dropna=False)
                codes = grouped.ngroup().to_numpy()
                heads = pdf[by].iloc[np.unique(codes, return_index=True)[1]]
                uniques = list(heads.itertuples(index=False, name=None))
                order = np.argsort(codes, kind="stable")
                ends = np.cumsum(np.bincount(codes, minlength=len(uniques)))
                starts = np.concatenate([[0], ends[:-1]])
                x, wx, ex = x[order], wx[order], ex[order]
                groups = zip(uniques, starts, ends)
            else:
                groups = [((), 0, len(x))]
            for key, s, e in groups:
                v = np.concatenate([(wx[s:e].T @ x[s:e])[upper], ex[s:e].sum(axis=0)])
                acc[key] = acc[key] + v if key in acc else v
            if len(acc) >= held:
                yield emit(acc)
                acc = {}
        if acc:
            yield emit(acc)

    return df.select(*names).mapInPandas(run, T.StructType(fields))


def within_sums(
    groups: DataFrame, k: int, scale: str | None = None, extra: Sequence[str] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum over groups of scale * (m_ij - m_0i m_0j / m_00), of scale * m_0i, for i, j >= 1, and of `extra`.

    Column 0 of the moments is the constant, so the first sum is the cross product after each
    group's (weighted) means are taken out. One job.
    """
    pairs = [(i, j) for i in range(1, k) for j in range(i, k)]
    s = f"`{scale}` * " if scale else ""
    at = lambda i, j: f"m[{triangle_at(i, j, k)}]"
    if len(pairs) + k - 1 + len(extra) <= MAX_SQL_SUMS:
        sums = [f"sum({s}({at(i, j)} - {at(0, i)} * {at(0, j)} / m[0]))" for i, j in pairs]
        sums += [f"sum({s}{at(0, i)})" for i in range(1, k)] + [f"sum(`{c}`)" for c in extra]
        total = groups.agg(F.expr(f"array({', '.join(sums)})").alias("m")).head()["m"]
    else:
        names = list(extra)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first = [triangle_at(0, i, k) for i in range(1, k)]
            rest = [triangle_at(i, j, k) for i, j in pairs]
            left, right = [i - 1 for i, _ in pairs], [j - 1 for _, j in pairs]
            last = len(pairs) + k - 1
            acc = np.zeros(last + len(names))
            for pdf in batches:
                if not len(pdf):
                    continue
                m = np.stack(pdf["m"].to_numpy())
                w = pdf["s"].to_numpy(dtype=float)[:, None]
                lin = m[:, first]
                acc[: len(pairs)] += (w * (m[:, rest] - lin[:, left] * lin[:, right] / m[:, :1])).sum(axis=0)
                acc[len(pairs):last] += (w * lin).sum(axis=0)
                acc[last:] += pdf[names].to_numpy(dtype=float).sum(axis=0)
            yield pd.DataFrame({"m": [acc.tolist()]})

        weight = F.col(scale) if scale else F.lit(1.0)
        parts = groups.select("m", weight.alias("s"), *names).mapInPandas(run, "m array<double>")
        total = sum_vectors(parts, "m").head()["m"]
    if total is None or total[0] is None:
        raise ValueError("no complete rows to fit")
    rest = np.asarray(total[len(pairs):], dtype=float)
    return symmetric(total[: len(pairs)], k - 1), rest[: k - 1], rest[k - 1:]

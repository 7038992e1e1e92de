"""Fitted model: coefficient table, intervals and scalar statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .design import Design
from .tdist import t_quantile, two_sided_p

TABLE_SCHEMA = "term string, estimate double, se double, stat double, df double, p double"


@dataclass
class Fit:
    family: str
    design: Design
    kept: list[int]
    coef: np.ndarray  # standardised scale, kept columns
    bread: np.ndarray  # inverse information on that scale
    dispersion: float
    df_resid: float
    normal: bool = False
    absorb: str | tuple[str, str] | None = None
    effects: DataFrame | list[DataFrame] | None = None  # (absorbed column, __alpha); of two sets, one for each
    stats: dict = field(default_factory=dict)
    owned: list = field(default_factory=list)
    again: Callable[[str], Fit] | None = None  # the same model without the rows that miss a column

    def refit(self, col: str) -> Fit:
        """The model fitted again without the rows that miss `col`."""
        if self.again is None:
            raise ValueError(f"{col} is missing in some rows; leave them out and fit again")
        return self.again(col)

    @property
    def terms(self) -> list[str]:
        return [self.design.names[i] for i in self.kept]

    @property
    def aliased(self) -> list[str]:
        return [n for i, n in enumerate(self.design.names) if i not in set(self.kept)]

    @property
    def xcols(self) -> list[str]:
        return [self.design.xcols[i] for i in self.kept]

    @property
    def back(self) -> np.ndarray:
        return self.design.back[np.ix_(self.kept, self.kept)]

    @property
    def estimate(self) -> np.ndarray:
        b = self.back @ self.coef
        if self.design.shift_y and self.design.xcols[0] == "__one":
            b = b.copy()
            b[0] += self.design.shift_y
        return b

    @property
    def vcov(self) -> np.ndarray:
        return self.dispersion * self.back @ self.bread @ self.back.T

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0.0))

    def __getitem__(self, term: str) -> float:
        return float(self.estimate[self.terms.index(term)])

    @property
    def spark(self):
        return self.design.data.sparkSession

    def rows(self, terms: Sequence[str] | None = None) -> list[tuple]:
        df = None if self.normal else float(self.df_resid)
        found = dict(zip(self.terms, zip(self.estimate, self.se)))
        out = []
        for name in terms or self.design.names:
            if name not in found:
                out.append((name, None, None, None, None, None))
                continue
            est, se = map(float, found[name])
            stat = est / se if se > 0 else None
            p = None if stat is None else two_sided_p(stat, df)
            out.append((name, est, se, stat, df, p))
        return out

    def table(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, estimate, se, stat, df, p); dropped collinear terms have null numbers."""
        return self.spark.createDataFrame(self.rows(terms), TABLE_SCHEMA)

    def summary(self) -> DataFrame:
        """Scalar statistics as (name, value) rows."""
        base = {"n": self.design.n, "rank": len(self.kept), "df_resid": self.df_resid, "dispersion": self.dispersion}
        rows = [(k, float(v)) for k, v in {**base, **self.stats}.items()]
        return self.spark.createDataFrame(rows, "name string, value double")

    def confint(self, level: float = 0.95) -> DataFrame:
        return confint(self.table(), level)

    def release(self) -> None:
        """Give back the cached rows and the effects table; what was read from the fit before stays, plans on it do not."""
        self.design.release()
        for table in self.owned:
            table.release()


def confint(table: DataFrame, level: float = 0.95) -> DataFrame:
    """(term, estimate, low, high) from a coefficient table; the table has one row per coefficient."""
    out = []
    for r in table.collect():
        if r["se"] is None:
            out.append((r["term"], r["estimate"], None, None))
            continue
        q = t_quantile(level, r["df"])
        out.append((r["term"], r["estimate"], r["estimate"] - q * r["se"], r["estimate"] + q * r["se"]))
    return table.sparkSession.createDataFrame(out, "term string, estimate double, low double, high double")


def inverse_link(col: Column | str, family: str) -> Column:
    """Linear predictor or coefficient to the response scale."""
    c = F.col(col) if isinstance(col, str) else col
    if family == "poisson":
        return F.exp(c)
    if family == "binomial":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
    return c

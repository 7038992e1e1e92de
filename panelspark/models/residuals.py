"""Fitted values and residuals as columns of the model's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import strict_avg
from ..operators.windows import lag_by
from .design import linear_predictor
from .fit import Fit, inverse_link


def _with_mean(fit: Fit) -> DataFrame:
    d = fit.design
    eta = linear_predictor(fit.xcols, fit.coef) + F.col("__off") + F.lit(d.shift_y)
    data = d.data
    if fit.absorb is not None:
        if fit.effects is None:
            raise ValueError("this model keeps no group effects")
        for effects in fit.effects if isinstance(fit.effects, list) else [fit.effects]:
            group, value = effects.columns
            data = data.join(effects, group)  # one row per group; groups left out of the fit go
            eta = eta + F.col(value)
    return data.withColumn("__mean", inverse_link(eta, fit.family))


def _visible(df: DataFrame, name: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__") and c != name])


def predict(fit: Fit, name: str = "predicted") -> DataFrame:
    """The rows used in the fit with their mean on the response scale."""
    return _visible(_with_mean(fit).withColumn(name, F.col("__mean")), name)


def deviance_residuals(fit: Fit, name: str = "resid") -> DataFrame:
    y, mu = F.col("__y") + F.lit(fit.design.shift_y), F.col("__mean")
    if fit.family == "poisson":
        half = F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0)) - (y - mu)
    elif fit.family == "binomial":
        half = F.when(y > 0.5, -F.log(mu)).otherwise(-F.log1p(-mu))
    else:
        half = (y - mu) * (y - mu) / 2
    size = F.sqrt(F.greatest(2 * half, F.lit(0.0)))
    return _visible(_with_mean(fit).withColumn(name, F.signum(y - mu) * size), name)


def lagged_residual(
    fit: Fit, ids: Sequence[str] | str, time: str, name: str = "reslag1", across: bool = False, periods: int = 1
) -> DataFrame:
    """Rows with the deviance residual of the same id `periods` periods before, for a refit with that term.

    `time` counts periods. Where that period is missing there is none, and the row drops out of the refit, as does the first
    of an id. If an id has several rows in that period their mean is taken. A window with a range frame finds the value:
    rows are shuffled by id once, and nothing is joined. `across=True` takes the row before instead, whatever its period and
    whosever it is.
    """
    rows = deviance_residuals(fit, "__res_lag")
    if across:
        return lag_by(rows, ids, time, "__res_lag", name, True).drop("__res_lag")
    keys = [ids] if isinstance(ids, str) else list(ids)
    before = Window.partitionBy(*keys).orderBy(F.col(time).cast("long")).rangeBetween(-periods, -periods)
    return rows.withColumn(name, F.avg("__res_lag").over(before)).drop("__res_lag")


def predict_by(fit: Fit, by: Sequence[str]) -> DataFrame:
    """Mean prediction and mean outcome per group."""
    rows = _with_mean(fit)
    return rows.groupBy(*by).agg(
        strict_avg("__mean").alias("mean_predicted"), strict_avg(F.col("__y") + F.lit(fit.design.shift_y)).alias("mean_observed")
    )

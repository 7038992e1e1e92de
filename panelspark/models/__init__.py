"""Regressions whose sums are Spark aggregates and whose solves are coefficient-sized."""

from .cluster import cluster_se
from .design import Factor, Harmonic, Spline
from .fixed import fe_logit, fe_poisson
from .fit import Fit, inverse_link
from .glm import poisson_glm
from .linear import ols, vif, wls
from .residuals import deviance_residuals, lagged_residual, predict, predict_by

__all__ = [
    "Factor", "Fit", "Harmonic", "Spline", "cluster_se", "deviance_residuals", "fe_logit", "fe_poisson",
    "inverse_link", "lagged_residual", "ols", "poisson_glm", "predict", "predict_by", "vif", "wls",
]

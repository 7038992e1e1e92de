"""Registered queries, one or more per operator, over the given tables."""

from . import calendar, columns, estimators, figures, places, relations, scans  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

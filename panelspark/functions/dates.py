"""Calendar columns, event windows and base/plot windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col

SPREADSHEET_ORIGIN = "1899-12-30"


def parse_us_date(c: Column | str) -> Column:
    """Month/day/year text to a date; null when it does not parse."""
    return F.try_to_date(as_col(c), "M/d/yyyy")


def from_serial(n: Column | str, origin: str = SPREADSHEET_ORIGIN) -> Column:
    """Spreadsheet serial day number to a date."""
    return F.date_add(F.lit(origin).cast("date"), as_col(n).cast("int"))


def days_since(date: Column | str, origin: str) -> Column:
    return F.date_diff(as_col(date), F.lit(origin).cast("date"))


def quarter_label(date: Column | str) -> Column:
    d = as_col(date)
    return F.concat_ws("-", F.year(d), F.quarter(d))


def month_name(date: Column | str) -> Column:
    return F.date_format(as_col(date), "MMMM")


def weekday_name(date: Column | str) -> Column:
    return F.date_format(as_col(date), "EEEE")


def stratum(date: Column | str, weekday: bool = True) -> Column:
    """year:month[:weekday] matching stratum with calendar month numbers."""
    d = as_col(date)
    parts = [F.year(d), F.month(d)] + ([weekday_name(d)] if weekday else [])
    return F.when(d.isNotNull(), F.concat_ws(":", *parts))


def event_window(date: Column | str, event: str, before: int, after: int) -> Column:
    """1 in the `before` days up to and including the event, 2 in the days after it, else 0.

    The far edges are open: day -before and day +after are outside.
    """
    d = days_since(date, event)
    return F.coalesce(
        F.when((d > -before) & (d <= 0), F.lit(1)).when((d > 0) & (d < after), F.lit(2)),
        F.lit(0),
    )


def month_date(year: Column | str, month: Column | str) -> Column:
    return F.make_date(as_col(year), as_col(month), F.lit(1))


@dataclass(frozen=True)
class PeriodWindow:
    """`n` consecutive periods from (year, start), in a year of `n` periods."""

    year: int
    start: int
    n: int

    def labels(self) -> list[str]:
        first = self.year * self.n + self.start - 1
        return [f"{k // self.n}.{k % self.n + 1}" for k in range(first, first + self.n)]

    def contains(self, year: Column | str, period: Column | str) -> Column:
        first = self.year * self.n + self.start - 1
        k = as_col(year) * self.n + as_col(period) - 1
        return k.between(first, first + self.n - 1)


def base_periods(year: int, start: int | None, n: int) -> tuple[PeriodWindow, PeriodWindow]:
    """Base window and the plot window one year later; `start=None` means the calendar year."""
    first = 1 if start is None else start
    if not 1 <= first <= n:
        raise ValueError(f"start must be within 1..{n}")
    return PeriodWindow(year, first, n), PeriodWindow(year + 1, first, n)

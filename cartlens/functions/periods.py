"""Reporting periods. Every helper takes an explicit ``as_of`` date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col


def period_start(c: Column | str, unit: str) -> Column:
    """First day of the week (Monday) or month; keeps the year, so weeks of two
    years never merge."""
    if unit == "day":
        return col(c).cast("date")
    return F.trunc(col(c), unit)


def month_label(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def add_months(day: dt.date, n: int) -> dt.date:
    """First day of the month n months away."""
    total = day.year * 12 + day.month - 1 + n
    return dt.date(total // 12, total % 12 + 1, 1)


def last_whole_periods(as_of: dt.date, unit: str, n: int) -> tuple[dt.date, dt.date]:
    """[start, end) of the last n complete weeks or months before ``as_of``."""
    if unit == "week":
        end = as_of - dt.timedelta(days=as_of.weekday())
        return end - dt.timedelta(weeks=n), end
    if unit == "month":
        end = as_of.replace(day=1)
        return add_months(end, -n), end
    raise ValueError(f"unit must be week or month, not {unit}")


def prior_days(as_of: dt.date, n: int = 7) -> tuple[dt.date, dt.date]:
    """[start, end) of the n days before ``as_of``."""
    return as_of - dt.timedelta(days=n), as_of


def cutoff_month(as_of: dt.date, cut_day: int = 14) -> str:
    """Latest month that may be settled: two back before the cut-off day of the
    month, one back from that day on."""
    return add_months(as_of, -2 if as_of.day < cut_day else -1).strftime("%Y-%m")


def in_ranges(c: Column | str, ranges) -> Column:
    """True when the date lies in one of the closed ranges; one scan for all."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | col(c).between(F.lit(lo), F.lit(hi))
    return out

"""Day arithmetic, reporting periods and look-back ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

DEFAULT_LOOKBACK_DAYS = 7

# The reporting periods and the unit each one truncates to.
PERIOD_UNITS = {"D": "DAY", "W": "WEEK", "M": "MONTH"}


def day_gap(a: Column, b: Column) -> Column:
    """Midnights between two times, regardless of order (23:59 to 00:01 is 1)."""
    return F.abs(F.date_diff(F.to_date(a), F.to_date(b)))


def as_date(value: dt.date | dt.datetime | str) -> dt.date:
    """The calendar date of a date, a datetime or an ISO text."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


def lookback_range(as_of, days: int | None = DEFAULT_LOOKBACK_DAYS) -> tuple[dt.date, dt.date]:
    """First and last date of a look-back; both count, so N days give N + 1 dates."""
    end = as_date(as_of)
    return end - dt.timedelta(days=days or DEFAULT_LOOKBACK_DAYS), end


def within_dates(column: Column, dtype: DataType, start=None, end=None) -> Column:
    """``start <= calendar date of column <= end`` as a half-open range on the raw column.

    Comparing the raw column keeps the filter in a form that parquet row-group
    statistics can answer. ``dtype`` is the column's type.
    """
    condition = F.lit(True)
    if start is not None:
        condition = condition & (column >= F.lit(as_date(start)).cast(dtype))
    if end is not None:
        after = as_date(end) + dt.timedelta(days=1)
        condition = condition & (column < F.lit(after).cast(dtype))
    return condition


def period_start(column: Column, period: str) -> Column:
    """First date of the day, Monday-based week or month that holds a time."""
    if period not in PERIOD_UNITS:
        raise ValueError(f"unknown period {period!r}, expected one of {sorted(PERIOD_UNITS)}")
    if period == "D":
        return F.to_date(column)
    return F.trunc(F.to_date(column), PERIOD_UNITS[period])


def period_label(start: Column, period: str) -> Column:
    """Text of a period: ``2024-01-31``, ``2024-01-29/2024-02-04`` or ``2024-01``."""
    if period == "W":
        return F.concat_ws(
            "/", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd")
        )
    return F.date_format(start, "yyyy-MM" if period == "M" else "yyyy-MM-dd")

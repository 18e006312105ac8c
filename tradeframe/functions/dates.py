"""Date filters and month keys. The current date is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Day = dt.date | str | None


def day(value: dt.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def in_period(column: Column | str, start: Day = None, end: Day = None) -> Column | None:
    """Condition for ``start <= column <= end``; None when both bounds are open.

    On a timestamp column the end bound is midnight of the end day, so later
    events of that day are outside."""
    column = F.col(column) if isinstance(column, str) else column
    parts = []
    if start is not None:
        parts.append(column >= day(start))
    if end is not None:
        parts.append(column <= day(end))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def within(df: DataFrame, column: str, start: Day = None, end: Day = None) -> DataFrame:
    """Keep the rows of a period; no filter is added for an open bound."""
    condition = in_period(column, start, end)
    return df if condition is None else df.filter(condition)


def month_of(column: Column | str) -> Column:
    """First day of the month, as a date (independent of the session time zone)."""
    return F.trunc(column, "month")

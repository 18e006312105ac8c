"""Exact money and quantity arithmetic on decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
QUANTITY = "decimal(10,2)"
RATE = "decimal(5,2)"
AVERAGE = "decimal(18,2)"
# Sums over whole tables: 28 digits hold 10^15 rows of the largest money value.
TOTAL = "decimal(28,2)"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def total(value: Column | str) -> Column:
    """Sum; null on an empty or all-null group."""
    return F.sum(_column(value)).cast(TOTAL)


def total_or_zero(value: Column | str) -> Column:
    return F.coalesce(total(value), F.lit(0).cast(TOTAL))


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Rounded quotient, null when the denominator is zero."""
    return F.round(numerator / F.nullif(denominator, F.lit(0)), digits).cast(AVERAGE)


def average(value: Column | str) -> Column:
    """Mean of the non-null values, rounded half up to two places."""
    value = _column(value)
    return ratio(F.sum(value), F.count(value))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_of_ones(condition: Column) -> Column:
    """``sum(case when .. then 1 else 0 end)``: null, not zero, on empty input."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")

"""Running monthly reports. The state is one row per month, so it stays small without a
watermark, and late records count as they do in the batch report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradeframe.operators import reports


def running_sales(orders: DataFrame) -> DataFrame:
    """The batch report's plan on a stream of orders; use update mode."""
    return reports.sales_by_month(orders)


def running_cash_flow(transactions: DataFrame) -> DataFrame:
    return reports.cash_flow(transactions)

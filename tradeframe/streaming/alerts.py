"""Low-stock alerts from the ledger stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def low_stock_crossings(ledger: DataFrame, products: DataFrame) -> DataFrame:
    """One row per posted event that takes an active product from above its minimum to
    the minimum or below."""
    levels = products.filter("is_active").select(F.col("id").alias("_id"), "name", "min_stock_level")
    changes = F.col("accepted") & (F.col("is_approved") | (F.col("movement_type") == "APPROVE"))
    crossed = (F.col("quantity_before") > F.col("min_stock_level")) & (
        F.col("quantity_after") <= F.col("min_stock_level"))
    return ledger.filter(changes).join(levels, F.col("product_id") == F.col("_id")).filter(crossed).select(
        "product_id", "name", F.col("id").alias("movement_id"), "movement_date", "quantity_before", "quantity_after",
        "min_stock_level",
        (F.col("min_stock_level") - F.col("quantity_after")).cast("decimal(18,2)").alias("shortage"))

"""Reference rows of a new installation, as literal data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tradeframe.operators.writes import with_defaults
from tradeframe.sources.tables import conform

# Role names and their permission documents.
ROLES = [
    (1, "super_admin", '{"all": true}'),
    (2, "admin", '{"users": true, "settings": true, "reports": true}'),
    (3, "manager", '{"sales": true, "purchases": true, "stock": true, "reports": true}'),
    (4, "accountant", '{"finance": true, "reports": true, "analytics": true}'),
    (5, "sales", '{"sales": true, "customers": true, "quotes": true, "orders": true}'),
    (6, "warehouse", '{"stock": true, "products": true, "movements": true}'),
    (7, "viewer", '{"view_only": true}'),
]

# Settings that have a default.
SETTINGS = [
    (1, "currency", "DZD", "system", True),
    (2, "language", "fr", "system", True),
    (3, "timezone", "Africa/Algiers", "system", True),
    (4, "vat_rate", "19", "finance", True),
    (5, "fiscal_year_start", "01-01", "finance", False),
    (6, "low_stock_alert", "true", "inventory", False),
    (7, "backup_enabled", "true", "system", False),
]

# Top product families. Their path is null.
FAMILIES = [
    (1, "STONE", "Natural Stone"),
    (2, "MARBLE", "Marble"),
    (3, "GRANITE", "Granite"),
    (4, "TOOLS", "Tools & Equipment"),
    (5, "SUPPLIES", "Supplies"),
]

# Payment models, each a list of (percentage, days after the order, text).
PAYMENT_MODELS = [
    (1, "30/70 Model", True,
     '[{"percentage": 30, "days_offset": 0, "description": "Down payment"},'
     ' {"percentage": 70, "days_offset": 30, "description": "Final payment"}]'),
    (2, "50/50 Model", False,
     '[{"percentage": 50, "days_offset": 0, "description": "Down payment"},'
     ' {"percentage": 50, "days_offset": 30, "description": "Final payment"}]'),
    (3, "25/25/25/25 Model", False,
     '[{"percentage": 25, "days_offset": 0, "description": "First installment"},'
     ' {"percentage": 25, "days_offset": 30, "description": "Second installment"},'
     ' {"percentage": 25, "days_offset": 60, "description": "Third installment"},'
     ' {"percentage": 25, "days_offset": 90, "description": "Final installment"}]'),
]

# The first warehouse.
WAREHOUSES = [(1, "WH-001", "Main Warehouse", "Default Location", "active", True)]


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    """The reference tables under their declared schemas."""
    rows = {
        "user_roles": (ROLES, "id long, name string, permissions string"),
        "settings": (SETTINGS, "id long, key string, value string, category string, is_public boolean"),
        "product_families": ([(*f, 1, True) for f in FAMILIES],
                             "id long, code string, name string, level int, is_active boolean"),
        "payment_schedule_models": ([(*m, "active") for m in PAYMENT_MODELS],
                                    "id long, name string, is_default boolean, terms string, status string"),
        "warehouses": (WAREHOUSES, "id long, code string, name string, address string, status string, "
                                   "is_default boolean"),
    }
    # by way of Arrow the rows become a local relation, whose small size the optimizer knows
    return {
        table: conform(with_defaults(
            spark.createDataFrame(pd.DataFrame(data, columns=StructType.fromDDL(ddl).names), ddl), table), table)
        for table, (data, ddl) in rows.items()
    }

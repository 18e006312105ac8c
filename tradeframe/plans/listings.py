"""Listing specs: which columns are joined, searched, filtered and sorted."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.functions.ranking import newest
from tradeframe.operators.documents import PARTY, pick
from tradeframe.operators.hierarchy import families_with_counts
from tradeframe.operators.listing import (
    Listing, ListSpec, Lookup, join_lookups, list_rows, select_rows, sort_key)


PEOPLE = (Lookup("created_by", "users", {"created_by_username": "username"}),
          Lookup("approved_by", "users", {"approved_by_username": "username"}))
FAMILY = Lookup("family_id", "product_families", {"family_name": "name"})


def _table(name: str):
    return lambda db: db[name]


def _party(table: str, key: str, prefix: str) -> tuple[Lookup]:
    return (Lookup(key, table, {f"{prefix}_{c}": c for c in PARTY}),)


def _low_stock(db) -> DataFrame:
    low = db["products"].filter("is_active and quantity_in_stock <= min_stock_level")
    return low.withColumn("shortage", (F.col("min_stock_level") - F.col("quantity_in_stock")).cast("decimal(10,2)"))


def _families(db) -> DataFrame:
    return families_with_counts(db["product_families"], db["products"])


LISTINGS = {
    "products": ListSpec(
        _table("products"),
        (Lookup("family_id", "product_families", {"family_name": "name", "family_code": "code"}),),
        search=("name", "sku", "barcode"),
        filters={"family_id": "family_id", "is_active": "is_active"},
        flags={"low_stock": "quantity_in_stock <= min_stock_level"},
        sortable=("name", "sku", "quantity_in_stock", "cost_price", "selling_price", "created_at")),
    "low_stock": ListSpec(_low_stock, (FAMILY,), sort=(("shortage", "desc"),)),
    "families": ListSpec(_families, sort=(("path", "asc"),)),
    "movements": ListSpec(
        _table("stock_movements"),
        (Lookup("product_id", "products", {"product_name": "name", "product_sku": "sku"}, how="inner"), *PEOPLE),
        filters={"product_id": "product_id", "movement_type": "movement_type", "warehouse": "warehouse"},
        period="movement_date", sort=(("movement_date", "desc"), ("created_at", "desc"))),
    "customers": ListSpec(_table("customers"), search=("name", "email", "company")),
    "suppliers": ListSpec(_table("suppliers"), search=("name", "email", "company")),
    "quotes": ListSpec(
        _table("sales_quotes"), _party("customers", "customer_id", "customer"),
        filters={"status": "status", "customer_id": "customer_id"}, period="quote_date"),
    "sales_orders": ListSpec(
        _table("sales_orders"), _party("customers", "customer_id", "customer"),
        filters={"status": "status", "customer_id": "customer_id"}, period="order_date"),
    "purchase_orders": ListSpec(
        _table("purchase_orders"), _party("suppliers", "supplier_id", "supplier"),
        filters={"status": "status", "supplier_id": "supplier_id"}, period="order_date"),
    "invoices": ListSpec(
        _table("invoices"), (Lookup("customer_id", "customers", {"customer_name": "name"}),),
        search=("invoice_number", "customer_name"),
        filters={"payment_status": "payment_status", "customer_id": "customer_id"}),
    "transactions": ListSpec(
        _table("financial_transactions"), (Lookup("account_id", "accounts", {"account_name": "name"}),),
        filters={"type": "type", "account_id": "account_id"},
        period="transaction_date", sort=(("transaction_date", "desc"),)),
    "accounts": ListSpec(_table("accounts"), filters={"type": "type", "is_active": "is_active"},
                         sort=(("name", "asc"),)),
    "users": ListSpec(
        _table("users"), (Lookup("role_id", "user_roles", {"role_name": "name"}),),
        search=("username", "email", "first_name", "last_name"),
        filters={"role": "role_name", "is_active": "is_active"}),
}


def enrich(db, entity: str, keys: DataFrame | None = None) -> DataFrame:
    """The joined rows of a listing without paging: all, or those of the given keys."""
    spec = LISTINGS[entity]
    return join_lookups(pick(spec.base(db), spec.key, keys), db, spec.lookups)


def product_history(db, newest_n: int = 50, product_id: int | None = None) -> DataFrame:
    """The newest movements of one product, or of each product, with people's names."""
    order = [sort_key("movement_date", "desc"), F.col("id").desc()]
    movements = db["stock_movements"]
    if product_id is not None:
        rows = movements.filter(F.col("product_id") == product_id).orderBy(*order).limit(newest_n)
    else:
        rows = newest(movements, ["product_id"], order, newest_n)
    return join_lookups(rows, db, PEOPLE)


def family_details(db) -> DataFrame:
    """Every family, active or not, with parent, creator and product count."""
    families = db["product_families"]
    rows = families_with_counts(families, db["products"], active_only=False)
    if "created_by" in families.columns:
        rows = PEOPLE[0].join(rows, db)
    return rows


def saved_search(db, entity: str, filters: str, sort_config: str | None = None, page: int = 1,
                 limit: int = 20) -> Listing:
    """Run a stored search. ``filters`` is a JSON object of listing arguments,
    ``sort_config`` one with ``field`` and ``direction``. Only the spec's own filters
    and sort fields can be named."""
    spec = LISTINGS[entity]
    arguments = json.loads(filters)
    allowed = set(spec.filters) | set(spec.flags) | {"search", "start", "end"}
    unknown = set(arguments) - allowed
    if unknown:
        raise ValueError(f"filters not allowed: {sorted(unknown)}")
    sort = json.loads(sort_config) if sort_config else {}
    return list_rows(spec, db, page=page, limit=limit, sort_by=sort.get("field"),
                     sort_order=sort.get("direction", "desc"), **arguments)


def matching(db, entity: str, **filters) -> DataFrame:
    """All rows of a listing that pass the filters, unsorted."""
    return select_rows(LISTINGS[entity], db, **filters)

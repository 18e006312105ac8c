"""Documents: header, party and items together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.functions.ranking import line_numbers

PARTY = ["name", "email", "phone", "company"]


@dataclass(frozen=True)
class DocumentKind:
    headers: str
    items: str
    link: str           # item column that points to the header
    party: str          # table of the business partner
    party_key: str      # header column that points to it
    prefix: str         # prefix of the partner's columns
    product_columns: tuple[str, ...]


QUOTE = DocumentKind("sales_quotes", "sales_quote_items", "quote_id", "customers", "customer_id", "customer",
                     ("sku", "unit"))
SALES_ORDER = DocumentKind("sales_orders", "sales_order_items", "order_id", "customers", "customer_id", "customer",
                           ("sku", "unit", "quantity_in_stock"))
PURCHASE_ORDER = DocumentKind("purchase_orders", "purchase_order_items", "order_id", "suppliers", "supplier_id",
                              "supplier", ("sku", "unit", "quantity_in_stock", "reorder_point"))


def with_party(headers: DataFrame, parties: DataFrame, party_key: str, prefix: str) -> DataFrame:
    """Left join of the partner's contact columns."""
    party = parties.select(F.col("id").alias("_party"), *[F.col(c).alias(f"{prefix}_{c}") for c in PARTY])
    return headers.join(party, F.col(party_key) == F.col("_party"), "left").drop("_party")


def with_products(items: DataFrame, products: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    product = products.select(F.col("id").alias("_product"), F.col("name").alias("product_name"), *columns)
    return items.join(product, F.col("product_id") == F.col("_product"), "left").drop("_product")


def pick(df: DataFrame, key: str, keys: DataFrame | None) -> DataFrame:
    """Only the rows whose key is in ``keys`` (one column); all rows without keys."""
    if keys is None:
        return df
    wanted = keys.select(keys[keys.columns[0]].alias("_wanted"))
    return df.join(wanted, F.col(key) == F.col("_wanted"), "left_semi")


def document_lines(db, kind: DocumentKind, keys: DataFrame | None = None) -> DataFrame:
    """One row per header and item with partner and product data; a header without
    items has one row with null item columns."""
    headers = with_party(pick(db[kind.headers], "id", keys), db[kind.party], kind.party_key, kind.prefix)
    items = with_products(pick(db[kind.items], kind.link, keys), db["products"], kind.product_columns)
    return headers.join(items, F.col("id") == F.col(kind.link), "left").drop(kind.link)


def documents(db, kind: DocumentKind, page_lines: int, keys: DataFrame | None = None) -> DataFrame:
    """Header rows with ``items`` as an array ordered by line number.

    A document comes in pages of ``page_lines`` items (column ``page``, from 0), counted by
    position, whatever the line numbers are; so no array grows without bound, and a
    document of up to ``page_lines`` items is one row. Line numbers are unique within a
    document. A header without items has page 0 with an empty array."""
    headers = with_party(pick(db[kind.headers], "id", keys), db[kind.party], kind.party_key, kind.prefix)
    items = with_products(pick(db[kind.items], kind.link, keys), db["products"], kind.product_columns)
    fields = ["line_number"] + [c for c in items.columns if c not in ("line_number", kind.link)]
    pages = (
        line_numbers(items, kind.link, "line_number", out="_at").withColumn("page", F.floor((F.col("_at") - 1) / page_lines))
        .groupBy(F.col(kind.link).alias("_doc"), "page")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
    )
    empty = F.array().cast(pages.schema["items"].dataType)
    return (
        headers.join(pages, F.col("id") == F.col("_doc"), "left").drop("_doc")
        .withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
        .withColumn("items", F.coalesce("items", empty))
    )

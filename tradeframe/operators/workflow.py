"""Batch jobs of the sales, purchase and invoice workflow."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.functions.dates import Day, day
from tradeframe.functions.keys import document_number
from tradeframe.functions.money import MONEY, QUANTITY, TOTAL
from tradeframe.functions.ranking import line_numbers
from tradeframe.operators.documents import pick
from tradeframe.operators.writes import Changed, first_reason, latest_values, missing, split_by

# Allowed payment states of an invoice.
PAYMENT_STATUSES = ["unpaid", "partial", "paid", "overdue", "cancelled"]
SHIPPING = ("shipped", "delivered")
RECEIVING = ("received", "completed")


class Converted(NamedTuple):
    orders: DataFrame
    items: DataFrame
    quotes: DataFrame     # the whole quote table after the change
    rejected: DataFrame


def convert_quotes(quotes: DataFrame, items: DataFrame, today: Day, id_base: int,
                   requests: DataFrame | None = None) -> Converted:
    """Turn approved quotes into pending orders dated today, with their amounts and
    items. The order's key is ``id_base`` plus the quote's, so a repeated run makes
    the same orders. With ``requests`` (column ``id``) only those are converted, and
    unknown or unapproved ones are rejected. Quotes converted before keep their order;
    ``updated_at`` of the quotes, if they have it, takes the day."""
    chosen = pick(quotes.filter(F.col("status") == "approved"), "id", requests)
    order_id = (F.col("id") + F.lit(id_base)).cast("bigint")
    amounts = [c for c in ("subtotal", "discount_percentage", "discount_amount", "tax_percentage", "tax_amount",
                           "total_amount", "notes") if c in quotes.columns]
    orders = chosen.select(
        order_id.alias("id"), document_number("SO", day(today), order_id).alias("order_number"), "customer_id",
        F.col("id").alias("quote_id"), day(today).alias("order_date"), F.lit("pending").alias("status"), *amounts)
    lines = pick(items, "quote_id", chosen.select("id")).withColumn(
        "order_id", (F.col("quote_id") + F.lit(id_base)).cast("bigint")).drop("quote_id")
    mark = chosen.select(F.col("id").alias("_converted"))
    after = quotes.join(mark, F.col("id") == F.col("_converted"), "left").select(
        *[F.when(F.col("_converted").isNotNull(), day(today).cast(quotes.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)
          for c in quotes.columns if c not in ("status", "converted_to_order")],
        F.when(F.col("_converted").isNotNull(), "converted").otherwise(F.col("status")).alias("status"),
        F.coalesce((F.col("_converted") + F.lit(id_base)).cast("bigint"),
                   F.col("converted_to_order") if "converted_to_order" in quotes.columns else F.lit(None)).cast("bigint").alias("converted_to_order"))
    asked = requests.select("id") if requests is not None else quotes.select("id").filter(F.lit(False))
    states = quotes.select(F.col("id").alias("_id"), F.col("status").alias("_status"))
    marked = asked.join(states, F.col("id") == F.col("_id"), "left")
    rejected = split_by(marked, first_reason(
        (F.col("_id").isNull(), "quote not found"),
        (F.col("_status") != "approved", "only approved quotes can be converted"),
    )).rejected.select("id", "reason")
    return Converted(orders, lines, after, rejected)


class StockEffect(NamedTuple):
    movements: DataFrame
    products: DataFrame   # the whole product table with its new stock
    orders: DataFrame     # the whole order table with its new status
    rejected: DataFrame


def _apply_order_events(db_products: DataFrame, orders: DataFrame, items: DataFrame, events: DataFrame,
                        triggers: tuple[str, ...], sign: int, kind: str, document: str, label: str) -> StockEffect:
    known = orders.select(F.col("id").alias("_order"), "order_number")
    valid = events.select(F.col("id").alias("_event_order"), F.col("status").alias("_event"), "at").join(
        known, F.col("_event_order") == F.col("_order"))
    moving = valid.filter(F.col("_event").isin(*triggers))
    movements = moving.join(items, F.col("_order") == F.col("order_id")).select(
        "product_id",
        F.lit(kind).alias("movement_type"),
        "quantity",
        F.lit(document).alias("reference_type"),
        F.col("_order").alias("reference_id"),
        F.concat(F.lit(label), F.col("order_number")).alias("notes"),
        F.col("at").alias("movement_date"),
    )
    # each item counts once per event of its order
    times = moving.groupBy("_order").agg(F.count(F.lit(1)).alias("_times"))
    moved = items.join(times, F.col("order_id") == F.col("_order")).groupBy(F.col("product_id").alias("_product")).agg(
        F.sum(F.col("quantity") * F.col("_times").cast("decimal(8,0)")).cast(TOTAL).alias("_moved"))
    products = db_products.join(moved, F.col("id") == F.col("_product"), "left").select(
        *[c for c in db_products.columns if c != "quantity_in_stock"],
        (F.col("quantity_in_stock") + F.lit(sign) * F.coalesce("_moved", F.lit(0).cast(TOTAL)))
        .cast(TOTAL).alias("quantity_in_stock"))
    last = latest_values(events, "id", ["status"], "at")
    status = orders.join(last, F.col("id") == F.col("_key"), "left").select(
        *[c for c in orders.columns if c != "status"],
        F.coalesce("_new_status", "status").alias("status"), F.col("_at").alias("updated_at"))
    unknown = events.join(known, F.col("id") == F.col("_order"), "left_anti").withColumn(
        "reason", F.lit("order not found"))
    return StockEffect(movements, products, status, unknown)


def ship_orders(products: DataFrame, orders: DataFrame, items: DataFrame, events: DataFrame) -> StockEffect:
    """Order events (``id, status, at``): ``shipped`` and ``delivered`` each take the
    item quantities out of stock, so an order with both counts twice. The stock level
    is not checked."""
    return _apply_order_events(products, orders, items, events, SHIPPING, -1, "OUT", "sales_order", "Sales Order ")


def receive_orders(products: DataFrame, orders: DataFrame, items: DataFrame, events: DataFrame) -> StockEffect:
    """The same for purchase orders: ``received`` and ``completed`` each add to stock."""
    return _apply_order_events(products, orders, items, events, RECEIVING, 1, "IN", "purchase_order",
                               "Purchase Order ")


def cancel_purchase_orders(orders: DataFrame, requests: DataFrame, at: Column) -> Changed:
    """Cancel unless received or completed; the time is stamped."""
    asked = requests.select(F.col("id").alias("_asked")).distinct()
    open_order = ~F.col("status").isin(*RECEIVING)
    cancel = F.col("_asked").isNotNull() & open_order
    none = F.lit(None).cast("timestamp_ntz")
    table = orders.join(asked, F.col("id") == F.col("_asked"), "left").select(
        *[c for c in orders.columns if c not in ("status", "cancelled_at", "updated_at")],
        F.when(cancel, "cancelled").otherwise(F.col("status")).alias("status"),
        F.when(cancel, at).otherwise(F.col("cancelled_at") if "cancelled_at" in orders.columns else none)
        .alias("cancelled_at"),
        F.when(cancel, at).otherwise(F.col("updated_at") if "updated_at" in orders.columns else none)
        .alias("updated_at"),
    )
    states = orders.select(F.col("id").alias("_id"), F.col("status").alias("_status"))
    marked = requests.join(states, F.col("id") == F.col("_id"), "left")
    rejected = split_by(marked, first_reason(
        (F.col("_id").isNull(), "purchase order not found"),
        (F.col("_status").isin(*RECEIVING), "cannot cancel received or completed orders"),
    )).rejected.select("id", "reason")
    return Changed(table, rejected)


def reconcile(transactions: DataFrame, requests: DataFrame, at: Column) -> Changed:
    """Mark transactions as reconciled."""
    asked = requests.select(F.col("id").alias("_asked")).distinct()
    done = F.col("_asked").isNotNull()
    was = F.col("is_reconciled") if "is_reconciled" in transactions.columns else F.lit(False)
    when = F.col("reconciled_at") if "reconciled_at" in transactions.columns else F.lit(None).cast("timestamp_ntz")
    table = transactions.join(asked, F.col("id") == F.col("_asked"), "left").select(
        *[c for c in transactions.columns if c not in ("is_reconciled", "reconciled_at")],
        F.when(done, True).otherwise(was).alias("is_reconciled"),
        F.when(done, at).otherwise(when).alias("reconciled_at"))
    known = transactions.select(F.col("id").alias("_known"))
    unknown = requests.join(known, F.col("id") == F.col("_known"), "left_anti").withColumn(
        "reason", F.lit("transaction not found"))
    return Changed(table, unknown)


# --- replenishment ----------------------------------------------------------------

def reorder_suggestions(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Active products at or below their reorder point, with their supplier."""
    supplier = suppliers.select(
        F.col("id").alias("_supplier"), F.col("name").alias("supplier_name"),
        F.col("email").alias("supplier_email"), F.col("phone").alias("supplier_phone"))
    needed = (F.col("reorder_point") - F.col("quantity_in_stock")).cast(QUANTITY)
    low = products.filter(F.col("is_active") & (F.col("quantity_in_stock") <= F.col("reorder_point")))
    return low.join(supplier, F.col("default_supplier_id") == F.col("_supplier"), "left").select(
        "id", "name", "sku", "unit", "quantity_in_stock", "reorder_point", "reorder_quantity",
        F.col("_supplier").alias("supplier_id"), "supplier_name", "supplier_email", "supplier_phone",
        needed.alias("quantity_needed"),
        F.coalesce("reorder_quantity", needed).cast(QUANTITY).alias("suggested_order_quantity"),
    ).orderBy(F.col("quantity_needed").desc_nulls_first(), "id")


class AutoOrders(NamedTuple):
    orders: DataFrame
    items: DataFrame


def auto_orders(products: DataFrame, today: Day, id_base: int, keys: DataFrame | None = None) -> AutoOrders:
    """One draft purchase order per supplier for its products at or below the reorder
    point, active or not. Without a reorder quantity the order is the shortage plus
    ten. A missing last price counts as zero. Lines are numbered by product."""
    shortage = F.col("reorder_point") - F.col("quantity_in_stock") + 10
    price = F.coalesce("last_purchase_price", F.lit(0).cast(MONEY))
    chosen = pick(products, "id", keys).filter(
        F.col("default_supplier_id").isNotNull() & (F.col("quantity_in_stock") <= F.col("reorder_point")))
    lines = chosen.select(
        (F.col("default_supplier_id") + F.lit(id_base)).cast("bigint").alias("order_id"),
        F.col("default_supplier_id").alias("supplier_id"),
        F.col("id").alias("product_id"),
        F.coalesce("reorder_quantity", shortage).cast(QUANTITY).alias("quantity"),
        price.alias("unit_price"),
        F.concat(F.lit("Reorder: "), "name", F.lit(" ("), "sku", F.lit(")")).alias("description"),
    ).withColumn("line_total", F.round(F.col("quantity") * F.col("unit_price"), 2).cast("decimal(18,2)"))
    sums = F.round(F.sum(F.col("quantity") * F.col("unit_price")), 2).cast(TOTAL)
    orders = lines.groupBy("order_id", "supplier_id").agg(sums.alias("total_amount")).select(
        F.col("order_id").alias("id"),
        document_number("PO", day(today), "order_id").alias("order_number"),
        "supplier_id",
        day(today).alias("order_date"),
        F.lit("draft").alias("status"),
        F.col("total_amount").alias("subtotal"),
        "total_amount",
        F.lit("Auto-generated based on reorder points").alias("notes"),
    )
    return AutoOrders(orders, line_numbers(lines, "order_id", "product_id").drop("supplier_id"))


# --- invoices ---------------------------------------------------------------------

class Created(NamedTuple):
    rows: DataFrame
    rejected: DataFrame


def create_invoices(requests: DataFrame, today: Day) -> Created:
    """Invoices from requests (``id, customer_id, sales_order_id, issue_date, due_date,
    total_amount, tax_amount``). Customer and a non-zero total are needed; the date
    defaults to today and the tax to zero; all start unpaid."""
    split = split_by(requests, first_reason(
        (missing("customer_id"), "customer_id is required"),
        (missing("total_amount", zero_counts=True), "total_amount is required")))
    issued = F.coalesce("issue_date", day(today))
    rows = split.accepted.select(
        "id", document_number("INV", day(today), "id").alias("invoice_number"), "customer_id", "sales_order_id",
        issued.alias("issue_date"), "due_date", "total_amount",
        F.coalesce("tax_amount", F.lit(0)).cast(MONEY).alias("tax_amount"),
        F.lit("unpaid").alias("payment_status"))
    return Created(rows, split.rejected)


def invoice_open_orders(orders: DataFrame, invoices: DataFrame, today: Day, id_base: int) -> Created:
    """Invoice every order that has no invoice yet."""
    billed = invoices.filter("sales_order_id is not null").select(F.col("sales_order_id").alias("_billed"))
    pending = orders.join(billed, F.col("id") == F.col("_billed"), "left_anti")
    none = F.lit(None)
    requests = pending.select(
        (F.col("id") + F.lit(id_base)).cast("bigint").alias("id"), "customer_id",
        F.col("id").alias("sales_order_id"), none.cast("date").alias("issue_date"), none.cast("date").alias("due_date"),
        "total_amount", none.cast(MONEY).alias("tax_amount"))
    return create_invoices(requests, today)


# --- due dates and instalments ------------------------------------------------------

TERMS = "array<struct<percentage:decimal(5,2),days_offset:int,description:string>>"


def instalments(orders: DataFrame, models: DataFrame, model_key: str) -> Created:
    """Payment schedule of each order from its payment model (``model_key`` of the
    order): due dates by offset, amounts by percentage, the last line taking the
    rounding rest. An order that names no model takes the default one; an order whose
    model is unknown, or has no readable terms, is rejected. Each order is expanded on
    its own row; nothing is shuffled but the join with the models."""
    model = models.select(F.col("id").alias("_model"), F.from_json("terms", TERMS).alias("_terms"))
    standard = models.filter("is_default").agg(F.min("id")).first()[0]
    chosen = orders.withColumn("_asked", F.coalesce(F.col(model_key), F.lit(standard).cast("bigint")))
    split = split_by(chosen.join(model, F.col("_asked") == F.col("_model"), "left"), first_reason(
        (F.col("_asked").isNull(), "payment model is required"), (F.col("_model").isNull(), "payment model not found"),
        (F.coalesce(F.size("_terms"), F.lit(0)) <= 0, "payment model has no readable terms")))
    joined = split.accepted
    one_percent = F.lit("0.01").cast("decimal(3,2)")
    amounts = F.transform("_terms", lambda t: F.round(F.col("total_amount") * t["percentage"] * one_percent, 2)
                          .cast("decimal(15,2)"))
    lines = joined.withColumn("_amounts", amounts).select(
        F.col("id").alias("order_id"), "order_date", "total_amount", "_amounts",
        F.size("_terms").alias("_lines"), F.posexplode("_terms").alias("_position", "_term"))
    others = F.aggregate(F.slice("_amounts", 1, F.col("_lines") - 1), F.lit(0).cast("decimal(25,2)"),
                         lambda total, a: (total + a).cast("decimal(25,2)"))
    is_last = F.col("_position") == F.col("_lines") - 1
    return Created(lines.select(
        "order_id",
        (F.col("_position") + 1).alias("line_number"),
        F.date_add("order_date", F.col("_term.days_offset")).alias("due_date"),
        F.when(is_last, F.col("total_amount") - others).otherwise(F.col("_amounts")[F.col("_position")])
        .cast("decimal(15,2)").alias("amount"),
        F.col("_term.percentage").alias("percentage"),
        F.col("_term.description").alias("description"),
        F.lit("pending").alias("status"),
    ), split.rejected.select(*orders.columns, "reason"))


def expire_quotes(quotes: DataFrame, today: Day) -> DataFrame:
    """Open quotes past their validity become ``expired``."""
    late = F.col("status").isin("draft", "sent") & (F.col("valid_until") < day(today))
    return quotes.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))


def mark_overdue(invoices: DataFrame, today: Day) -> DataFrame:
    """Unpaid and partly paid invoices past their due date become ``overdue``."""
    late = F.col("payment_status").isin("unpaid", "partial") & (F.col("due_date") < day(today))
    return invoices.withColumn("payment_status", F.when(late, "overdue").otherwise(F.col("payment_status")))

"""Workflow jobs W1-W6, W9-W12, instalments X1, due dates X7. A job with several
results has one query per result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeframe.functions.dates import day
from tradeframe.functions.keys import document_number, movement_number
from tradeframe.operators import workflow, writes
from tradeframe.plans.catalogue import TODAY, query
from tradeframe.sources.seed import PAYMENT_MODELS, seed

BASE = 1_000_000_000_000
STAMP = f"timestamp '{TODAY} 12:00:00'"


def at():
    """The time that a job stamps on what it changes."""
    return F.lit(f"{TODAY} 12:00:00").cast("timestamp_ntz")


def number_sql(prefix: str, key: str) -> str:
    digits = TODAY.replace("-", "")
    return f"'{prefix}-{digits}-' || case when length({key}::varchar) < 6 then lpad({key}::varchar, 6, '0') else {key}::varchar end"


# --- quotes to orders ---------------------------------------------------------------

def _conversion_requests(db):
    """The quotes with a validity date, and as many keys without a quote."""
    quotes = db["sales_quotes"].filter("valid_until is not null")
    return quotes.select("id").unionAll(quotes.select(-F.col("id") - 1))


def _converted(db):
    return workflow.convert_quotes(db["sales_quotes"], db["sales_quote_items"], TODAY, BASE, _conversion_requests(db))


@query("w01_converted_orders", f"""
select id + {BASE} as id, {number_sql('SO', f'(id + {BASE})')} as order_number, customer_id, id as quote_id,
       date '{TODAY}' as order_date, 'pending' as status, total_amount
from sales_quotes where status = 'approved' and valid_until is not null""")
def converted_orders(db):
    return _converted(db).orders


@query("w01_converted_items", f"""
select i.quote_id + {BASE} as order_id, i.* exclude (quote_id)
from sales_quote_items i join sales_quotes q on q.id = i.quote_id where q.status = 'approved' and q.valid_until is not null""")
def converted_items(db):
    return _converted(db).items


@query("w01_quotes_after", f"""
select q.* exclude (status), case when status = 'approved' and valid_until is not null then 'converted' else status end as status,
       case when status = 'approved' and valid_until is not null then id + {BASE} end as converted_to_order
from sales_quotes q""")
def quotes_after(db):
    return _converted(db).quotes


@query("w01_rejected", """
select id, 'only approved quotes can be converted' as reason from sales_quotes where status <> 'approved'
  and valid_until is not null
union all select -id - 1, 'quote not found' from sales_quotes where valid_until is not null""")
def conversion_rejects(db):
    return _converted(db).rejected


# --- order events -------------------------------------------------------------------

def _events(orders, first: str, second: str, other: str):
    """Every order has an event: the first kind, or another one for pending orders. Orders
    above 250,000 get the second kind too, and for each cancelled order there is an
    event that names no order."""
    at = F.col("order_date").cast("timestamp_ntz")
    one = orders.select("id", F.when(F.col("status") != "pending", first).otherwise(other).alias("status"), at.alias("at"))
    two = orders.filter("total_amount > 250000").select(
        "id", F.lit(second), F.date_add("order_date", 2).cast("timestamp_ntz"))
    none = orders.filter("status = 'cancelled'").select(-F.col("id") - 1, F.lit(first), at)
    return one.unionAll(two).unionAll(none)


def events_sql(orders: str, first: str, second: str, other: str) -> str:
    return f"""
order_events as (
  select id, case when status <> 'pending' then '{first}' else '{other}' end as status, cast(order_date as timestamp) as at
  from {orders}
  union all select id, '{second}', cast(order_date + 2 as timestamp) from {orders} where total_amount > 250000
  union all select -id - 1, '{first}', cast(order_date as timestamp) from {orders} where status = 'cancelled')"""


def effect_sql(result: str, orders: str, items: str, first: str, second: str, other: str, kind: str, document: str,
               label: str, sign: str) -> str:
    moves = f"""
moves as (
  select i.product_id, '{kind}' as movement_type, i.quantity, '{document}' as reference_type, o.id as reference_id,
         '{label}' || o.order_number as notes, e.at as movement_date
  from order_events e join {orders} o on o.id = e.id join {items} i on i.order_id = o.id
  where e.status in ('{first}', '{second}'))"""
    head = "with " + events_sql(orders, first, second, other) + "," + moves
    return head + {
        "movements": "select * from moves",
        "products": f"""
select p.id, cast(p.quantity_in_stock {sign} coalesce(m.q, 0) as decimal(28,2)) as quantity_in_stock
from products p left join (select product_id, sum(quantity) as q from moves group by 1) m on m.product_id = p.id""",
        "orders": f"""
select o.id, arg_max(e.status, e.at) as status, max(e.at) as updated_at
from {orders} o join order_events e on e.id = o.id group by 1""",
        "rejected": f"""
select *, 'order not found' as reason from order_events where id not in (select id from {orders})""",
    }[result]


_SHIP = ("sales_orders", "sales_order_items", "shipped", "delivered", "confirmed", "OUT", "sales_order", "Sales Order ",
         "-")
_RECEIVE = ("purchase_orders", "purchase_order_items", "received", "completed", "approved", "IN", "purchase_order",
            "Purchase Order ", "+")


def _shipped(db):
    orders = db["sales_orders"]
    return workflow.ship_orders(db["products"], orders, db["sales_order_items"],
                                _events(orders, "shipped", "delivered", "confirmed"))


def _received(db):
    orders = db["purchase_orders"]
    return workflow.receive_orders(db["products"], orders, db["purchase_order_items"],
                                   _events(orders, "received", "completed", "approved"))


@query("w02_shipping_movements", effect_sql("movements", *_SHIP))
def shipping_movements(db):
    return _shipped(db).movements


@query("w02_stock_after_shipping", effect_sql("products", *_SHIP))
def stock_after_shipping(db):
    return _shipped(db).products.select("id", "quantity_in_stock")


@query("w02_orders_after_shipping", effect_sql("orders", *_SHIP))
def orders_after_shipping(db):
    return _shipped(db).orders.select("id", "status", "updated_at")


@query("w02_rejected_events", effect_sql("rejected", *_SHIP))
def rejected_shipping(db):
    return _shipped(db).rejected


@query("w03_receiving_movements", effect_sql("movements", *_RECEIVE))
def receiving_movements(db):
    return _received(db).movements


@query("w03_stock_after_receiving", effect_sql("products", *_RECEIVE))
def stock_after_receiving(db):
    return _received(db).products.select("id", "quantity_in_stock")


@query("w03_orders_after_receiving", effect_sql("orders", *_RECEIVE))
def orders_after_receiving(db):
    return _received(db).orders.select("id", "status", "updated_at")


@query("w03_rejected_events", effect_sql("rejected", *_RECEIVE))
def rejected_receiving(db):
    return _received(db).rejected


# --- cancelling, states, reconciling --------------------------------------------------

def _cancelled(db):
    orders = db["purchase_orders"]
    asked = orders.filter("actual_delivery_date is null").select("id").unionAll(
        orders.filter("status = 'pending'").select(-F.col("id")))
    return workflow.cancel_purchase_orders(orders, asked, at())


_CLOSED = "status in ('received', 'completed')"


@query("w04_cancelled_orders", f"""
select o.* exclude (status), case when actual_delivery_date is null and not {_CLOSED} then 'cancelled' else status end as status,
       case when actual_delivery_date is null and not {_CLOSED} then {STAMP} end as cancelled_at,
       case when actual_delivery_date is null and not {_CLOSED} then {STAMP} end as updated_at
from purchase_orders o""")
def cancelled_orders(db):
    return _cancelled(db).table


@query("w04_rejected_cancellations", f"""
select id, 'cannot cancel received or completed orders' as reason from purchase_orders
where actual_delivery_date is null and {_CLOSED}
union all select -id, 'purchase order not found' from purchase_orders where status = 'pending'""")
def rejected_cancellations(db):
    return _cancelled(db).rejected


_STATES = ("unpaid", "partial", "paid", "overdue", "cancelled", "lost", "")


def _payment_requests(db):
    """A payment change per invoice, a second one for untaxed invoices; the state follows
    the month, and some name a state that does not exist or none at all."""
    names = F.array(*[F.lit(s) for s in _STATES])
    rows = db["invoices"]
    pick = lambda shift: names[(F.month("issue_date") + shift) % 7].alias("payment_status")
    first = rows.select("id", pick(0), F.col("issue_date").cast("timestamp_ntz").alias("updated_at"))
    second = rows.filter("tax_amount is null").select("id", pick(3), F.date_add("issue_date", 9).cast("timestamp_ntz"))
    return first.unionAll(second)


_PAYMENTS = f"""
asked as (
  select id, [{', '.join(repr(s) for s in _STATES)}][month(issue_date) % 7 + 1] as payment_status, cast(issue_date as timestamp) as updated_at
  from invoices
  union all
  select id, [{', '.join(repr(s) for s in _STATES)}][(month(issue_date) + 3) % 7 + 1], cast(issue_date + 9 as timestamp)
  from invoices where tax_amount is null)"""
_ALLOWED = ", ".join(f"'{s}'" for s in workflow.PAYMENT_STATUSES)


def _payments(db):
    return writes.set_status(db["invoices"], _payment_requests(db), "payment_status", workflow.PAYMENT_STATUSES)


@query("w05_payment_status", f"""
with {_PAYMENTS}
select i.* exclude (payment_status), coalesce(a.s, payment_status) as payment_status, a.t as updated_at
from invoices i left join (select id, arg_max(payment_status, updated_at) as s, max(updated_at) as t
                           from asked where payment_status in ({_ALLOWED}) group by 1) a on a.id = i.id""")
def payment_status(db):
    return _payments(db).table


@query("w05_rejected_payment_status", f"""
with {_PAYMENTS}
select id, payment_status, updated_at,
       case when payment_status = '' then 'payment_status is required'
            else 'payment_status must be one of: {", ".join(workflow.PAYMENT_STATUSES)}' end as reason
from asked where payment_status not in ({_ALLOWED})""")
def rejected_payment_status(db):
    return _payments(db).rejected


@query("w05_quote_status", f"""
select q.* exclude (status), case when status = 'draft' then 'sent' else status end as status,
       case when status = 'draft' then {STAMP} end as updated_at
from sales_quotes q""")
def quote_status(db):
    quotes = db["sales_quotes"]
    asked = quotes.filter("status = 'draft'").select("id", F.lit("sent").alias("status"), at().alias("updated_at"))
    return writes.set_status(quotes, asked).table


@query("w05_order_status", f"""
select o.* exclude (status), case when status = 'pending' then 'confirmed' else status end as status,
       case when status = 'pending' then {STAMP} end as updated_at
from sales_orders o""")
def order_status(db):
    orders = db["sales_orders"]
    asked = orders.filter("status = 'pending'").select("id", F.lit("confirmed").alias("status"), at().alias("updated_at"))
    return writes.set_status(orders, asked).table


@query("w06_reconciled", f"""
select *, type = 'income' as is_reconciled, case when type = 'income' then {STAMP} end as reconciled_at
from financial_transactions""")
def reconciled(db):
    transactions = db["financial_transactions"]
    return workflow.reconcile(transactions, transactions.filter("type = 'income'").select("id"), at()).table


# --- replenishment --------------------------------------------------------------------

@query("w09_reorder_suggestions", """
select p.id, p.name, p.sku, p.unit, quantity_in_stock, reorder_point, reorder_quantity, s.id as supplier_id,
       s.name as supplier_name, s.email as supplier_email, s.phone as supplier_phone,
       cast(reorder_point - quantity_in_stock as decimal(10,2)) as quantity_needed,
       cast(coalesce(reorder_quantity, reorder_point - quantity_in_stock) as decimal(10,2)) as suggested_order_quantity
from products_with_supplier p left join suppliers s on s.id = p.default_supplier_id
where p.is_active and quantity_in_stock <= reorder_point""")
def reorder_suggestions(db):
    return workflow.reorder_suggestions(db["products_with_supplier"], db["suppliers"])


_AUTO = f"""
lines as (
  select default_supplier_id + {BASE} as order_id, default_supplier_id as supplier_id, id as product_id,
         cast(coalesce(reorder_quantity, reorder_point - quantity_in_stock + 10) as decimal(10,2)) as quantity,
         coalesce(last_purchase_price, cast(0 as decimal(12,2))) as unit_price,
         'Reorder: ' || name || ' (' || sku || ')' as description
  from products_with_supplier where default_supplier_id is not null and quantity_in_stock <= reorder_point)"""


def _auto(db):
    return workflow.auto_orders(db["products_with_supplier"], TODAY, BASE)


@query("w10_auto_orders", f"""
with {_AUTO}
select order_id as id, {number_sql('PO', 'order_id')} as order_number, supplier_id, date '{TODAY}' as order_date,
       'draft' as status, cast(round(sum(quantity * unit_price), 2) as decimal(28,2)) as subtotal,
       cast(round(sum(quantity * unit_price), 2) as decimal(28,2)) as total_amount,
       'Auto-generated based on reorder points' as notes
from lines group by order_id, supplier_id""")
def auto_orders(db):
    return _auto(db).orders


@query("w10_auto_order_items", f"""
with {_AUTO}
select order_id, product_id, quantity, unit_price, description,
       cast(round(quantity * unit_price, 2) as decimal(18,2)) as line_total,
       row_number() over (partition by order_id order by product_id) as line_number
from lines""")
def auto_order_items(db):
    return _auto(db).items


# --- invoices, numbers, due dates -------------------------------------------------------

@query("w11_invoices_for_open_orders", f"""
select id + {2 * BASE} as id, {number_sql('INV', f'(id + {2 * BASE})')} as invoice_number, customer_id, id + {BASE} as sales_order_id,
       date '{TODAY}' as issue_date, cast(null as date) as due_date, total_amount,
       cast(0 as decimal(12,2)) as tax_amount, 'unpaid' as payment_status
from sales_quotes where status = 'approved' and valid_until is not null and total_amount <> 0""")
def open_orders(db):
    """All stored orders and those just made from quotes; the stored ones are invoiced."""
    orders = db["sales_orders"].select("id", "customer_id", "total_amount").unionByName(
        _converted(db).orders.select("id", "customer_id", "total_amount"))
    return workflow.invoice_open_orders(orders, db["invoices"], TODAY, BASE).rows


def _invoice_requests(db):
    """A request per order: cancelled ones lack the customer, pending ones the date, small
    ones have a zero total and only large ones carry a tax."""
    status, amount = F.col("status"), F.col("total_amount")
    return db["sales_orders"].select(
        "id", F.when(status != "cancelled", F.col("customer_id")).alias("customer_id"),
        F.col("id").alias("sales_order_id"),
        F.when(status != "pending", F.col("order_date")).alias("issue_date"),
        F.date_add("order_date", 30).alias("due_date"),
        F.when(amount < 50000, F.lit(0)).otherwise(amount).cast("decimal(12,2)").alias("total_amount"),
        F.when(amount > 250000, F.lit(19)).cast("decimal(12,2)").alias("tax_amount"))


_REQUESTS = """
requests as (
  select id, case when status <> 'cancelled' then customer_id end as customer_id, id as sales_order_id,
         case when status <> 'pending' then order_date end as issue_date, cast(order_date + 30 as date) as due_date,
         cast(case when total_amount < 50000 then 0 else total_amount end as decimal(12,2)) as total_amount,
         cast(case when total_amount > 250000 then 19 end as decimal(12,2)) as tax_amount
  from sales_orders)"""


@query("w11_created_invoices", f"""
with {_REQUESTS}
select id, {number_sql('INV', 'id')} as invoice_number, customer_id, sales_order_id,
       coalesce(issue_date, date '{TODAY}') as issue_date, due_date, total_amount,
       cast(coalesce(tax_amount, 0) as decimal(12,2)) as tax_amount, 'unpaid' as payment_status
from requests where customer_id is not null and total_amount <> 0""")
def created_invoices(db):
    return workflow.create_invoices(_invoice_requests(db), TODAY).rows


@query("w11_rejected_invoices", f"""
with {_REQUESTS}
select *, case when customer_id is null then 'customer_id is required' else 'total_amount is required' end as reason
from requests where customer_id is null or total_amount = 0""")
def rejected_invoices(db):
    return workflow.create_invoices(_invoice_requests(db), TODAY).rejected


@query("w12_document_numbers", f"""
select id, {number_sql('SO', 'product_id')} as order_number, 'SM-' || movement_type || '-1998-' || id as movement_number
from stock_movements""")
def document_numbers(db):
    return db["stock_movements"].select(
        "id", document_number("SO", day(TODAY), "product_id").alias("order_number"),
        movement_number("movement_type", day(TODAY), "id").alias("movement_number"))


def _terms_sql() -> str:
    """The payment models as rows (model, position, lines, percentage, offset, text)."""
    import json
    rows = []
    for key, _, _, terms in PAYMENT_MODELS:
        parsed = json.loads(terms)
        rows += [f"({key}, {i}, {len(parsed)}, {t['percentage']}, {t['days_offset']}, '{t['description']}')"
                 for i, t in enumerate(parsed)]
    return f"terms(model, pos, n, pct, days, description) as (values {', '.join(rows)})"


_MODEL = "case o.status when 'completed' then 1 when 'pending' then 2 when 'cancelled' then case when o.total_amount > 250000 then 77 else 3 end end"


@query("x01_instalments", f"""
with {_terms_sql()},
parts as (
  select o.id as order_id, pos, n, cast(o.order_date + cast(days as int) as date) as due_date, pct, description, o.total_amount,
         cast(round(o.total_amount * pct * 0.01, 2) as decimal(15,2)) as part
  from sales_orders o join terms on terms.model = case when o.id % 5 = 0 then 1 else {_MODEL} end)
select order_id, cast(pos + 1 as int) as line_number, due_date,
       cast(case when pos = n - 1
                 then total_amount - coalesce(sum(part) over (partition by order_id order by pos
                                              rows between unbounded preceding and 1 preceding), 0)
                 else part end as decimal(15,2)) as amount,
       cast(pct as decimal(5,2)) as percentage, description, 'pending' as status
from parts""")
def instalments(db):
    return _instalments(db).rows


@query("x01_rejected_orders", f"""
select id, 'payment model not found' as reason from sales_orders o where id % 5 <> 0 and {_MODEL} = 77""")
def orders_without_model(db):
    return _instalments(db).rejected.select("id", "reason")


def _instalments(db):
    """Models by status; every fifth order names none, and large cancelled ones an unknown one."""
    status = F.col("status")
    model = F.when(status == "completed", 1).when(status == "pending", 2).when(F.col("total_amount") > 250000, 77).otherwise(3)
    orders = db["sales_orders"].withColumn("model_id", F.when(F.col("id") % 5 != 0, model).cast("bigint"))
    return workflow.instalments(orders, seed(db.spark)["payment_schedule_models"], "model_id")


@query("x07_expired_quotes", f"""
select q.* exclude (status),
       case when status in ('draft', 'sent') and valid_until < date '{TODAY}' then 'expired' else status end as status
from sales_quotes q""")
def expired_quotes(db):
    return workflow.expire_quotes(db["sales_quotes"], TODAY)


@query("x07_overdue_invoices", f"""
select i.* exclude (payment_status),
       case when payment_status in ('unpaid', 'partial') and due_date < date '{TODAY}' then 'overdue'
            else payment_status end as payment_status
from invoices i""")
def overdue_invoices(db):
    return workflow.mark_overdue(db["invoices"], TODAY)

"""Sales, purchase, stock and finance reports.

Grouped sums, counts and averages all have a map-side part, so a group that owns
much of the table reaches the shuffle as one partial row per task. Facts are
aggregated before they meet a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.functions.dates import Day, day, in_period, month_of, within
from tradeframe.functions.money import AVERAGE, TOTAL, average, count_where, ratio, sum_of_ones, total, total_or_zero
from tradeframe.functions.ranking import newest
from tradeframe.operators.listing import sort_key

# Movement types per meaning; the journal's own vocabulary.
INCOMING = ("IN", "RETURN", "ADJUSTMENT")
SOLD = ("OUT",)
PURCHASED = ("IN",)


def _is(column: str, value: str):
    return F.col(column) == F.lit(value)


def _rows():
    return F.count(F.lit(1))


def _low_stock():
    return F.col("quantity_in_stock") <= F.col("min_stock_level")


def _one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side: stacked, then each column's only value is taken."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


# --- overview -----------------------------------------------------------------

def dashboard(db, today: Day) -> DataFrame:
    """One row: this month's sales, invoices, active products, active customers."""
    month = F.trunc(day(today), "month")
    sales = db["sales_orders"].filter(F.col("order_date") >= month).agg(
        total_or_zero("total_amount").alias("monthly_revenue"), _rows().alias("monthly_orders"))
    invoices = db["invoices"].agg(
        _rows().alias("total_invoices"), count_where(_is("payment_status", "unpaid")).alias("unpaid_invoices"))
    products = db["products"].filter("is_active").agg(
        _rows().alias("total_products"), count_where(_low_stock()).alias("low_stock_count"))
    customers = db["customers"].filter("is_active").agg(_rows().alias("active_customers"))
    return _one_row(sales, invoices, products, customers)


def _in_order(report: DataFrame, *keys) -> DataFrame:
    """A report of few rows in its order; the state of a stream has none."""
    return report if report.isStreaming else report.orderBy(*keys)


def sales_by_month(orders: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return _in_order(within(orders, "order_date", start, end).groupBy(month_of("order_date").alias("month")).agg(
        _rows().alias("order_count"),
        total("total_amount").alias("revenue"),
        average("total_amount").alias("avg_order_value"),
    ), sort_key("month", "desc"))


def invoices_by_status(invoices: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return _in_order(within(invoices, "issue_date", start, end).groupBy("payment_status").agg(
        _rows().alias("invoice_count"), total_or_zero("total_amount").alias("total_amount")), sort_key("payment_status"))


def product_statistics(products: DataFrame) -> DataFrame:
    """Counts and stock value; the value is over all products, active or not."""
    return products.agg(
        _rows().alias("total_products"),
        count_where(F.col("is_active")).alias("active_products"),
        count_where(_low_stock()).alias("low_stock"),
        total_or_zero(F.col("quantity_in_stock") * F.col("selling_price")).alias("stock_value"),
    )


def customer_statistics(customers: DataFrame, today: Day) -> DataFrame:
    return customers.agg(
        _rows().alias("total_customers"),
        count_where(F.col("is_active")).alias("active_customers"),
        count_where(F.col("created_at") >= F.trunc(day(today), "month")).alias("new_this_month"),
    )


def order_statistics(orders: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Sums are null, not zero, when no order is in the period."""
    return within(orders, "order_date", start, end).agg(
        _rows().alias("total_orders"),
        total("total_amount").alias("total_revenue"),
        average("total_amount").alias("average_order_value"),
        *[sum_of_ones(_is("status", s)).alias(f"{s}_orders") for s in ("completed", "pending", "cancelled")],
    )


def purchase_statistics(orders: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return within(orders, "order_date", start, end).agg(
        _rows().alias("total_orders"),
        total("total_amount").alias("total_purchases"),
        average("total_amount").alias("average_order_value"),
        *[sum_of_ones(_is("status", s)).alias(f"{s}_orders")
          for s in ("completed", "pending", "received", "cancelled")],
    )


# --- partners -----------------------------------------------------------------

def supplier_performance(suppliers: DataFrame, orders: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Orders, spending, delivery time and completion rate per supplier.

    The period restricts the joined rows, so with a period a supplier without an
    order in it is not reported; without one every supplier is."""
    facts = within(orders, "order_date", start, end).groupBy(F.col("supplier_id").alias("_supplier")).agg(
        _rows().alias("_orders"),
        total("total_amount").alias("total_spent"),
        average("total_amount").alias("average_order_value"),
        average(F.datediff("actual_delivery_date", "order_date")).alias("avg_delivery_days"),
        count_where(_is("status", "completed")).alias("_completed"),
        count_where(_is("status", "cancelled")).alias("_cancelled"),
    )
    how = "left" if in_period("order_date", start, end) is None else "inner"
    zero = F.lit(0).cast("bigint")
    return suppliers.select("id", F.col("name").alias("supplier_name")).join(
        facts, F.col("id") == F.col("_supplier"), how
    ).select(
        "id", "supplier_name",
        F.coalesce("_orders", zero).alias("total_orders"),
        "total_spent", "average_order_value", "avg_delivery_days",
        F.coalesce("_completed", zero).alias("completed_orders"),
        F.coalesce("_cancelled", zero).alias("cancelled_orders"),
        ratio(F.col("_completed") * 100, F.col("_orders")).alias("completion_rate"),
    )


def _partner_kpis(partners: DataFrame, orders: DataFrame, link: str, amount: str, start: Day, end: Day) -> DataFrame:
    facts = within(orders, "order_date", start, end).groupBy(F.col(link).alias("_partner")).agg(
        _rows().alias("_orders"),
        total("total_amount").alias("_amount"),
        average("total_amount").alias("_average"),
        F.max("order_date").alias("last_order_date"),
        F.min("order_date").alias("first_order_date"),
    )
    return partners.join(facts, F.col("id") == F.col("_partner"), "left").select(
        *partners.columns,
        F.coalesce("_orders", F.lit(0).cast("bigint")).alias("total_orders"),
        F.coalesce("_amount", F.lit(0).cast("decimal(28,2)")).alias(amount),
        F.coalesce("_average", F.lit(0).cast("decimal(18,2)")).alias("average_order_value"),
        "last_order_date", "first_order_date",
    )


def customer_kpis(customers: DataFrame, orders: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Every customer stays, with zeros when it has no order in the period."""
    return _partner_kpis(customers, orders, "customer_id", "total_revenue", start, end)


def supplier_kpis(suppliers: DataFrame, orders: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return _partner_kpis(suppliers, orders, "supplier_id", "total_spent", start, end)


def customer_orders(db, start: Day = None, end: Day = None, newest_n: int = 50) -> DataFrame:
    """The newest orders per customer with their creator and item count.

    The ranking comes first: items are then counted only for orders that are shown."""
    orders = newest(within(db["sales_orders"], "order_date", start, end), ["customer_id"],
                    [sort_key("order_date", "desc"), F.col("id").desc()], newest_n)
    shown = orders.select(F.col("id").alias("_shown"))
    counts = db["sales_order_items"].join(shown, F.col("order_id") == F.col("_shown"), "left_semi").groupBy(
        F.col("order_id").alias("_order")).agg(_rows().alias("_items"))
    creators = db["users"].select(F.col("id").alias("_user"), F.col("username").alias("created_by_username"))
    return (
        orders.join(counts, F.col("id") == F.col("_order"), "left")
        .join(creators, F.col("created_by") == F.col("_user"), "left")
        .withColumn("item_count", F.coalesce("_items", F.lit(0).cast("bigint")))
        .drop("_order", "_items", "_user")
    )


# --- products -----------------------------------------------------------------

def product_kpis(products: DataFrame, families: DataFrame, movements: DataFrame,
                 incoming=INCOMING, sold=SOLD, purchased=PURCHASED) -> DataFrame:
    """Stock by movements (incoming types add, every other type subtracts), sold and
    purchased quantities, number of movements."""
    quantity, kind = F.col("quantity"), F.col("movement_type")
    zero = F.lit(0).cast("decimal(10,2)")
    facts = movements.groupBy(F.col("product_id").alias("_product")).agg(
        total(F.when(kind.isin(*incoming), quantity).otherwise(-quantity)).alias("_stock"),
        total(F.when(kind.isin(*sold), quantity).otherwise(zero)).alias("_sold"),
        total(F.when(kind.isin(*purchased), quantity).otherwise(zero)).alias("_purchased"),
        _rows().alias("_movements"),
    )
    names = families.select(F.col("id").alias("_family"), F.col("name").alias("family_name"))
    none = F.lit(0).cast("decimal(28,2)")
    return (
        products.join(facts, F.col("id") == F.col("_product"), "left")
        .join(names, F.col("family_id") == F.col("_family"), "left")
        .select(
            *products.columns, "family_name",
            F.coalesce("_stock", none).alias("current_stock"),
            F.coalesce("_sold", none).alias("total_sold"),
            F.coalesce("_purchased", none).alias("total_purchased"),
            F.coalesce("_movements", F.lit(0).cast("bigint")).alias("total_movements"),
        )
    )


def product_movements(movements: DataFrame, users: DataFrame, start: Day = None, end: Day = None,
                      newest_n: int = 100) -> DataFrame:
    """The newest movements per product with their creator."""
    rows = newest(within(movements, "movement_date", start, end), ["product_id"],
                  [sort_key("movement_date", "desc"), F.col("id").desc()], newest_n)
    creators = users.select(F.col("id").alias("_user"), F.col("username").alias("created_by_username"))
    return rows.join(creators, F.col("created_by") == F.col("_user"), "left").drop("_user")


def product_sales_by_month(movements: DataFrame, start: Day = None, end: Day = None, sold=SOLD) -> DataFrame:
    """Quantity, unweighted mean price and revenue per product and month."""
    rows = within(movements.filter(F.col("movement_type").isin(*sold)), "movement_date", start, end)
    return rows.groupBy("product_id", month_of("movement_date").alias("month")).agg(
        total("quantity").alias("quantity_sold"),
        average("unit_price").alias("avg_price"),
        total(F.col("quantity") * F.col("unit_price")).alias("total_revenue"),
    )


def top_customers(movements: DataFrame, orders: DataFrame, customers: DataFrame, newest_n: int = 10,
                  sold=SOLD) -> DataFrame:
    """The customers who bought most of each product, by amount.

    Movements are summed per (product, order) first, which makes the distinct order
    count a plain count later on."""
    amount = F.col("quantity") * F.col("unit_price")
    per_order = movements.filter(F.col("movement_type").isin(*sold) & F.col("sales_order_id").isNotNull()).groupBy(
        "product_id", "sales_order_id").agg(
        total("quantity").alias("_quantity"), F.sum(amount).cast("decimal(32,4)").alias("_amount"))
    owners = orders.select(F.col("id").alias("_order"), "customer_id")
    sums = (
        per_order.join(owners, F.col("sales_order_id") == F.col("_order"))
        .groupBy("product_id", "customer_id")
        .agg(
            F.sum("_quantity").cast("decimal(28,2)").alias("total_quantity"),
            F.sum("_amount").cast("decimal(28,2)").alias("total_amount"),
            _rows().alias("order_count"),
        )
    )
    names = customers.select(F.col("id").alias("_customer"), F.col("name").alias("customer_name"))
    known = sums.join(names, F.col("customer_id") == F.col("_customer")).drop("_customer")
    return newest(known, ["product_id"], [F.col("total_amount").desc(), F.col("customer_id").asc()], newest_n)


# --- finance ------------------------------------------------------------------

def vat_by_month(invoices: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """The invoice total is taken as the amount without tax."""
    tax = F.coalesce("tax_amount", F.lit(0).cast("decimal(12,2)"))
    return _in_order(within(invoices, "issue_date", start, end).groupBy(month_of("issue_date").alias("month")).agg(
        _rows().alias("invoice_count"),
        total_or_zero("total_amount").alias("total_excl_tax"),
        total_or_zero("tax_amount").alias("total_tax"),
        total_or_zero(F.col("total_amount") + tax).alias("total_incl_tax"),
    ), sort_key("month", "desc"))


def balance_sheet_accounts(accounts: DataFrame) -> DataFrame:
    """Active accounts by type and name."""
    return accounts.filter("is_active").select("id", "name", "type", "balance", "currency").orderBy(
        *(sort_key(c) for c in ("type", "name", "id")))


def _amount_of(kind: str):
    return F.when(_is("type", kind), F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))


def balance_sheet_totals(transactions: DataFrame, as_of: Day = None) -> DataFrame:
    zero = F.lit(0).cast("decimal(28,2)")
    sums = within(transactions, "transaction_date", None, as_of).agg(
        total_or_zero(_amount_of("income")).alias("total_income"),
        total_or_zero(_amount_of("expense")).alias("total_expense"))
    return sums.withColumn("net", (F.coalesce("total_income", zero) - F.coalesce("total_expense", zero))
                           .cast("decimal(28,2)"))


def cash_flow(transactions: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Per month: income, expense, net. Every type but income lowers the net, so a
    transfer does too, without being an expense."""
    signed = F.when(_is("type", "income"), F.col("amount")).otherwise(-F.col("amount"))
    return _in_order(within(transactions, "transaction_date", start, end).groupBy(
        month_of("transaction_date").alias("month")).agg(
        total(_amount_of("income")).alias("income"),
        total(_amount_of("expense")).alias("expense"),
        total(signed).alias("net"),
    ), sort_key("month", "desc"))


def financial_summary(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Income, expenses, net (transfers left out) and the balance of active accounts."""
    sums = transactions.filter(F.col("type").isin("income", "expense")).agg(
        total_or_zero(_amount_of("income")).alias("total_income"),
        total_or_zero(_amount_of("expense")).alias("total_expenses"))
    sums = sums.withColumn("net_position", (F.col("total_income") - F.col("total_expenses")).cast("decimal(28,2)"))
    balance = accounts.filter("is_active").agg(total_or_zero("balance").alias("account_balance"))
    return _one_row(sums, balance)


# --- series shown on the dashboard ----------------------------------------------

def monthly_trend(orders: DataFrame, today: Day, months: int = 12) -> DataFrame:
    """Revenue of the last months, each beside the month before it. Months without
    orders appear with zero."""
    last = F.trunc(day(today), "month")
    first = F.add_months(last, -(months))
    spine = orders.sparkSession.range(1).select(
        F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))
    sums = (
        orders.filter((F.col("order_date") >= first) & (F.col("order_date") < F.add_months(last, 1)))
        .groupBy(month_of("order_date").alias("_month"))
        .agg(_rows().alias("_orders"), total("total_amount").alias("_revenue"))
    )
    none = F.lit(0).cast("decimal(28,2)")
    filled = spine.join(sums, F.col("month") == F.col("_month"), "left").select(
        "month", F.coalesce("_orders", F.lit(0).cast("bigint")).alias("order_count"),
        F.coalesce("_revenue", none).alias("revenue"))
    # the previous month by its date: an equi-join on thirteen rows
    before = filled.select(F.add_months("month", 1).alias("_next"), F.col("revenue").alias("previous_revenue"))
    return filled.join(before, F.col("month") == F.col("_next")).select(
        "month", "order_count", "revenue", "previous_revenue",
        (F.col("revenue") - F.col("previous_revenue")).cast("decimal(28,2)").alias("change"))


def top_products(movements: DataFrame, products: DataFrame, newest_n: int = 10, sold=SOLD) -> DataFrame:
    """Best-selling products by revenue, with the margin over cost."""
    sums = movements.filter(F.col("movement_type").isin(*sold)).groupBy(F.col("product_id").alias("id")).agg(
        total("quantity").alias("quantity_sold"),
        total(F.col("quantity") * F.col("unit_price")).alias("revenue"))
    names = products.select(F.col("id").alias("_id"), "name", "cost_price")
    margin = F.col("revenue") - F.col("quantity_sold").cast("decimal(22,2)") * F.col("cost_price")
    return (
        sums.orderBy(F.col("revenue").desc(), F.col("id")).limit(newest_n)
        .join(names, F.col("id") == F.col("_id"))
        .select("id", "name", "quantity_sold", "revenue", F.round(margin, 2).cast("decimal(28,2)").alias("margin"))
    )


def vat_position(invoices: DataFrame, purchases: DataFrame, rate: str = "19.00", start: Day = None,
                 end: Day = None) -> DataFrame:
    """Tax collected on invoices minus tax deductible on purchases, per month. Purchase
    orders that carry no tax amount are taxed at ``rate`` percent."""
    collected = within(invoices, "issue_date", start, end).select(
        month_of("issue_date").alias("month"),
        F.coalesce("tax_amount", F.lit(0).cast("decimal(12,2)")).cast("decimal(18,2)").alias("collected"),
        F.lit(0).cast("decimal(18,2)").alias("deductible"))
    share = F.lit(rate).cast("decimal(5,2)") * F.lit("0.01").cast("decimal(3,2)")
    deductible = within(purchases.filter(F.col("status") != "cancelled"), "order_date", start, end).select(
        month_of("order_date").alias("month"),
        F.lit(0).cast("decimal(18,2)").alias("collected"),
        F.round(F.col("total_amount") * share, 2).cast("decimal(18,2)").alias("deductible"))
    return collected.unionAll(deductible).groupBy("month").agg(
        total("collected").alias("vat_collected"),
        total("deductible").alias("vat_deductible"),
        total(F.col("collected") - F.col("deductible")).alias("vat_due"),
    )


def customer_rollups(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """The stored summary columns of customers, computed again."""
    return customer_kpis(customers.select("id"), orders).select(
        "id", F.col("total_revenue").alias("total_sales"), "total_orders", "average_order_value", "last_order_date")


def supplier_rollups(suppliers: DataFrame, orders: DataFrame) -> DataFrame:
    return supplier_kpis(suppliers.select("id"), orders).select(
        "id", F.col("total_spent").alias("total_purchases"), "total_orders")


def signed_changes(old: DataFrame, new: DataFrame, party: str, amount: str = "total_amount", date: str = "order_date", key: str = "id") -> DataFrame:
    """Per party, what the changes between two versions of some records add to its roll-up: ``orders``, ``valued`` (orders
    with an amount), ``amount``, ``latest`` (the latest date that was added) and ``gone`` (the latest that was removed).
    A record counts -1 as it was and +1 as it is; records that are alike in both fall out."""
    columns = [F.col(party).alias("party"), F.col(amount).alias("amount"), F.col(date).alias("date")]
    before = old.select(F.col(key).alias("_old"), F.struct(*columns).alias("_was"))
    after = new.select(F.col(key).alias("_new"), F.struct(*columns).alias("_is"))
    changed = before.join(after, F.col("_old") == F.col("_new"), "full_outer").filter(~F.col("_was").eqNullSafe(F.col("_is")))
    rows = changed.select(F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("_was").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("_is").alias("row")))).alias("c")).select("c.sign", "c.row.*")
    added, none = F.col("sign") > 0, F.lit(0).cast(TOTAL)
    return rows.filter("party is not null").groupBy("party").agg(
        F.sum("sign").alias("orders"), F.sum(F.when(F.col("amount").isNotNull(), F.col("sign")).otherwise(0)).alias("valued"),
        F.sum(F.coalesce(F.col("sign") * F.col("amount"), none)).cast(TOTAL).alias("amount"),
        F.max(F.when(added, F.col("date"))).alias("latest"), F.max(F.when(~added, F.col("date"))).alias("gone"))


def updated_rollups(stored: DataFrame, changes: DataFrame, orders: DataFrame, party: str = "customer_id") -> DataFrame:
    """Stored roll-ups of customers (``id, total_sales, total_orders, valued_orders, last_order_date``) after the changes
    that ``signed_changes`` gives, with ``average_order_value`` from them.

    Sums and counts follow from the changes alone. A last date that was removed, and that no added one replaces, is looked
    up in ``orders`` (the new ones); only the orders of such customers are read for it. Customers without changes
    stay as they are."""
    zero = F.lit(0).cast("bigint")
    joined = stored.join(changes.select(F.col("party").alias("_party"), *[F.col(c).alias(f"_{c}") for c in ("orders", "valued", "amount", "latest", "gone")]),
                         F.col("id") == F.col("_party"), "left")
    lost = (F.col("_gone") >= F.col("last_order_date")) & F.coalesce(F.col("_latest") < F.col("last_order_date"), F.lit(True))
    marked = joined.withColumn("_lost", F.coalesce(lost, F.lit(False)))
    asked = marked.filter("_lost").select(F.col("id").alias("_asked"))
    found = orders.join(asked, F.col(party) == F.col("_asked"), "left_semi").groupBy(F.col(party).alias("_looked")).agg(F.max("order_date").alias("_found"))
    n, total_sales = F.col("valued_orders") + F.coalesce("_valued", zero), (F.col("total_sales") + F.coalesce("_amount", F.lit(0).cast(TOTAL))).cast(TOTAL)
    last = F.when(F.col("_lost"), F.col("_found")).otherwise(F.greatest("last_order_date", "_latest"))
    return marked.join(found, F.col("id") == F.col("_looked"), "left").select(
        "id", total_sales.alias("total_sales"), (F.col("total_orders") + F.coalesce("_orders", zero)).alias("total_orders"), n.alias("valued_orders"),
        F.coalesce(ratio(total_sales, n), F.lit(0).cast(AVERAGE)).alias("average_order_value"), last.alias("last_order_date"))


def stored_rollups(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Roll-ups with the number of orders that have an amount, as ``updated_rollups`` takes them."""
    valued = orders.filter("total_amount is not null").groupBy(F.col("customer_id").alias("_customer")).agg(_rows().alias("_valued"))
    return customer_rollups(customers, orders).join(valued, F.col("id") == F.col("_customer"), "left").withColumn(
        "valued_orders", F.coalesce("_valued", F.lit(0).cast("bigint"))).drop("_customer", "_valued")

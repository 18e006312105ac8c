"""Reports R1-R19 and the dashboard series X3-X5."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeframe.operators import reports
from tradeframe.plans.catalogue import END, START, TODAY, query
from tradeframe.plans.view_sql import average, hundredths, total, total0
from tradeframe.sources.tables import run_sql, table_counts

COUNTED = ["users", "products", "customers", "suppliers"]


@query("s04_bound_parameters", f"""
select id, order_number, customer_id, order_date, total_amount from sales_orders
where total_amount >= 400000 and order_date <= date '{END}' and status = 'completed'""")
def bound_parameters(db):
    return run_sql(db.spark, """
        SELECT id, order_number, customer_id, order_date, total_amount FROM {orders}
        WHERE total_amount >= :least AND (:until IS NULL OR order_date <= CAST(:until AS DATE)) AND status = :status
        """, {"least": 400000, "until": END, "status": "completed"}, orders=db["sales_orders"])


@query("s05_table_counts", " union all ".join(
    f"select '{t}' as table_name, count(*) as row_count from {t}" for t in COUNTED))
def counts(db):
    return table_counts(db, COUNTED)


@query("r01_dashboard", f"""
select * from (select {total0('total_amount')} as monthly_revenue, count(*) as monthly_orders from sales_orders
               where order_date >= date_trunc('month', date '{TODAY}')) a
cross join (select count(*) as total_invoices, count(*) filter (where payment_status = 'unpaid') as unpaid_invoices
            from invoices) b
cross join (select count(*) as total_products,
                   count(*) filter (where quantity_in_stock <= min_stock_level) as low_stock_count
            from products where is_active) c
cross join (select count(*) as active_customers from customers where is_active) d""")
def dashboard(db):
    return reports.dashboard(db, TODAY)


_BY_MONTH = f"""
select cast(date_trunc('month', order_date) as date) as month, count(*) as order_count,
       {total('total_amount')} as revenue, {average('total_amount')} as avg_order_value
from sales_orders {{where}} group by 1"""


SALES_BY_MONTH = _BY_MONTH.format(where="")


@query("r02_sales_by_month", SALES_BY_MONTH)
def sales_by_month(db):
    return reports.sales_by_month(db["sales_orders"])


@query("r02_sales_by_month_period", _BY_MONTH.format(
    where=f"where order_date between date '{START}' and date '{END}'"))
def sales_by_month_period(db):
    return reports.sales_by_month(db["sales_orders"], START, END)


@query("r03_invoices_by_status", f"""
select payment_status, count(*) as invoice_count, {total0('total_amount')} as total_amount
from invoices where issue_date between date '{START}' and date '{END}' group by 1""")
def invoices_by_status(db):
    return reports.invoices_by_status(db["invoices"], START, END)


@query("r04_product_statistics", f"""
select count(*) as total_products, count(*) filter (where is_active) as active_products,
       count(*) filter (where quantity_in_stock <= min_stock_level) as low_stock,
       {total0('quantity_in_stock * selling_price')} as stock_value
from products""")
def product_statistics(db):
    return reports.product_statistics(db["products"])


@query("r05_customer_statistics", f"""
select count(*) as total_customers, count(*) filter (where is_active) as active_customers,
       count(*) filter (where created_at >= date_trunc('month', date '{TODAY}')) as new_this_month
from customers""")
def customer_statistics(db):
    return reports.customer_statistics(db["customers"], TODAY)


def _statistics(table: str, amount: str, states: list[str], where: str) -> str:
    ones = ", ".join(f"cast(sum(case when status = '{s}' then 1 else 0 end) as bigint) as {s}_orders" for s in states)
    return (f"select count(*) as total_orders, {total('total_amount')} as {amount}, "
            f"{average('total_amount')} as average_order_value, {ones} from {table} {where}")


_PERIOD = f"where order_date between date '{START}' and date '{END}'"


@query("r06_order_statistics", _statistics("sales_orders", "total_revenue", ["completed", "pending", "cancelled"],
                                           _PERIOD))
def order_statistics(db):
    return reports.order_statistics(db["sales_orders"], START, END)


@query("r06_order_statistics_empty", _statistics(
    "sales_orders", "total_revenue", ["completed", "pending", "cancelled"], "where order_date >= date '2030-01-01'"))
def order_statistics_empty(db):
    return reports.order_statistics(db["sales_orders"], "2030-01-01")


@query("r07_purchase_statistics", _statistics(
    "purchase_orders", "total_purchases", ["completed", "pending", "received", "cancelled"], _PERIOD))
def purchase_statistics(db):
    return reports.purchase_statistics(db["purchase_orders"], START, END)


_DAYS = "cast(actual_delivery_date - p.order_date as bigint)"
_PERFORMANCE = f"""
select s.id, s.name as supplier_name, count(p.id) as total_orders, {total('p.total_amount')} as total_spent,
       {average('p.total_amount')} as average_order_value,
       {hundredths(f"(2 * 100 * sum({_DAYS}) + count({_DAYS})) // (2 * count({_DAYS}))")} as avg_delivery_days,
       count(*) filter (where p.status = 'completed') as completed_orders,
       count(*) filter (where p.status = 'cancelled') as cancelled_orders,
       {hundredths("(2 * 10000 * count(*) filter (where p.status = 'completed') + count(p.id)) // (2 * count(p.id))")}
         as completion_rate
from suppliers s left join purchase_orders p on s.id = p.supplier_id {{where}} group by s.id, s.name"""


@query("r08_supplier_performance", _PERFORMANCE.format(where=""))
def supplier_performance(db):
    return reports.supplier_performance(db["suppliers"], db["purchase_orders"])


@query("r08_supplier_performance_period", _PERFORMANCE.format(
    where="where p.order_date between date '1998-08-01' and date '1998-08-05'"))
def supplier_performance_period(db):
    return reports.supplier_performance(db["suppliers"], db["purchase_orders"], "1998-08-01", "1998-08-05")


@query("r09_product_kpis", """
select p.*, f.name as family_name,
       cast(coalesce(m.stock, 0) as decimal(28,2)) as current_stock,
       cast(coalesce(m.sold, 0) as decimal(28,2)) as total_sold,
       cast(coalesce(m.bought, 0) as decimal(28,2)) as total_purchased, coalesce(m.n, 0) as total_movements
from products p left join product_families f on f.id = p.family_id
left join (select product_id,
                  sum(case when movement_type in ('IN', 'RETURN', 'ADJUSTMENT') then quantity else -quantity end) as stock,
                  sum(case when movement_type = 'OUT' then quantity else 0 end) as sold,
                  sum(case when movement_type = 'IN' then quantity else 0 end) as bought, count(*) as n
           from stock_movements group by product_id) m on m.product_id = p.id""")
def product_kpis(db):
    return reports.product_kpis(db["products"], db["product_families"], db["stock_movements"])


@query("r10_product_movements", f"""
select id, product_id, movement_type, quantity, unit_price, movement_date, created_by, created_by_username, rank
from (select m.*, u.username as created_by_username,
             row_number() over (partition by product_id order by movement_date desc, m.id desc) as rank
      from stock_movements m left join users u on u.id = m.created_by
      where movement_date between date '{START}' and date '{END}') t
where rank <= 100""")
def product_movements(db):
    rows = reports.product_movements(db["stock_movements"], db["users"], START, END)
    return rows.selectExpr("id", "product_id", "movement_type", "quantity", "unit_price", "movement_date",
                           "created_by", "created_by_username", "cast(rank as bigint) as rank")


@query("r11_product_sales_by_month", f"""
select product_id, cast(date_trunc('month', movement_date) as date) as month, {total('quantity')} as quantity_sold,
       {average('unit_price')} as avg_price, {total('quantity * unit_price')} as total_revenue
from stock_movements where movement_type = 'OUT' group by 1, 2""")
def product_sales_by_month(db):
    return reports.product_sales_by_month(db["stock_movements"])


@query("r12_top_customers", f"""
select * from (
  select t.*, row_number() over (partition by product_id order by total_amount desc, customer_id) as rank
  from (select m.product_id, c.id as customer_id, c.name as customer_name, {total('quantity')} as total_quantity,
               {total('quantity * unit_price')} as total_amount, count(distinct o.id) as order_count
        from stock_movements m join sales_orders o on m.sales_order_id = o.id join customers c on o.customer_id = c.id
        where m.movement_type = 'OUT' group by 1, 2, 3) t)
where rank <= 10""")
def top_customers(db):
    rows = reports.top_customers(db["stock_movements"], db["sales_orders"], db["customers"])
    return rows.selectExpr("product_id", "customer_id", "customer_name", "total_quantity", "total_amount",
                           "order_count", "cast(rank as bigint) as rank")


def _kpis(partner: str, orders: str, link: str, amount: str) -> str:
    return f"""
select c.*, count(distinct o.id) as total_orders, {total0('o.total_amount')} as {amount},
       coalesce({average('o.total_amount')}, 0) as average_order_value,
       max(o.order_date) as last_order_date, min(o.order_date) as first_order_date
from {partner} c left join {orders} o on o.{link} = c.id
     and o.order_date between date '1998-08-01' and date '1998-08-31'
group by all"""


@query("r13_customer_kpis", _kpis("customers", "sales_orders", "customer_id", "total_revenue"))
def customer_kpis(db):
    return reports.customer_kpis(db["customers"], db["sales_orders"], "1998-08-01", "1998-08-31")


@query("r14_customer_orders", """
select id, order_number, customer_id, order_date, status, total_amount, created_by, created_at, created_by_username,
       item_count, rank
from (select o.*, u.username as created_by_username, coalesce(i.n, 0) as item_count,
             row_number() over (partition by customer_id order by order_date desc, o.id desc) as rank
      from sales_orders o left join users u on u.id = o.created_by
      left join (select order_id, count(*) as n from sales_order_items group by 1) i on i.order_id = o.id) t
where rank <= 50""")
def customer_orders(db):
    return reports.customer_orders(db).selectExpr("* except (rank)", "cast(rank as bigint) as rank")


@query("r15_supplier_kpis", _kpis("suppliers", "purchase_orders", "supplier_id", "total_spent"))
def supplier_kpis(db):
    return reports.supplier_kpis(db["suppliers"], db["purchase_orders"], "1998-08-01", "1998-08-31")


@query("r16_vat_by_month", f"""
select cast(date_trunc('month', issue_date) as date) as month, count(*) as invoice_count,
       {total0('total_amount')} as total_excl_tax, {total0('tax_amount')} as total_tax,
       {total0('total_amount + coalesce(tax_amount, 0)')} as total_incl_tax
from invoices group by 1""")
def vat_by_month(db):
    return reports.vat_by_month(db["invoices"])


@query("r17_balance_sheet_accounts", "select id, name, type, balance, currency from accounts where is_active")
def balance_sheet_accounts(db):
    return reports.balance_sheet_accounts(db["accounts"])


@query("r17_balance_sheet_totals", f"""
select i as total_income, e as total_expense, cast(i - e as decimal(28,2)) as net
from (select {total0("case when type = 'income' then amount else 0 end")} as i,
             {total0("case when type = 'expense' then amount else 0 end")} as e
      from financial_transactions where transaction_date <= date '{TODAY}')""")
def balance_sheet_totals(db):
    return reports.balance_sheet_totals(db["financial_transactions"], TODAY)


CASH_FLOW = f"""
select cast(date_trunc('month', transaction_date) as date) as month,
       {total("case when type = 'income' then amount else 0 end")} as income,
       {total("case when type = 'expense' then amount else 0 end")} as expense,
       {total("case when type = 'income' then amount else -amount end")} as net
from financial_transactions group by 1"""


@query("r18_cash_flow", CASH_FLOW)
def cash_flow(db):
    return reports.cash_flow(db["financial_transactions"])


@query("r19_financial_summary", f"""
select i as total_income, e as total_expenses, cast(i - e as decimal(28,2)) as net_position, account_balance
from (select {total0("case when type = 'income' then amount else 0 end")} as i,
             {total0("case when type = 'expense' then amount else 0 end")} as e
      from financial_transactions)
cross join (select {total0('balance')} as account_balance from accounts where is_active)""")
def financial_summary(db):
    return reports.financial_summary(db["financial_transactions"], db["accounts"])


@query("x03_monthly_trend", f"""
with spine as (select unnest(range(date '1997-08-01', date '1998-09-01', interval 1 month)) as m),
filled as (select cast(m as date) as month, count(o.id) as order_count, {total0('o.total_amount')} as revenue
           from spine left join sales_orders o on date_trunc('month', o.order_date) = m group by 1)
select * from (select month, order_count, revenue, lag(revenue) over (order by month) as previous_revenue,
                      cast(revenue - lag(revenue) over (order by month) as decimal(28,2)) as change from filled)
where month >= date '1997-09-01'""")
def monthly_trend(db):
    return reports.monthly_trend(db["sales_orders"], TODAY)


@query("x03_top_products", f"""
select p.id, p.name, quantity_sold, revenue,
       cast(round(revenue - cast(quantity_sold as decimal(22,2)) * p.cost_price, 2) as decimal(28,2)) as margin
from (select product_id, {total('quantity')} as quantity_sold, {total('quantity * unit_price')} as revenue
      from stock_movements where movement_type = 'OUT' group by 1 order by revenue desc, product_id limit 10) m
join products p on p.id = m.product_id""")
def top_products(db):
    return reports.top_products(db["stock_movements"], db["products"])


@query("x04_vat_position", f"""
select month, {total('collected')} as vat_collected, {total('deductible')} as vat_deductible,
       {total('collected - deductible')} as vat_due
from (select cast(date_trunc('month', issue_date) as date) as month,
             cast(coalesce(tax_amount, 0) as decimal(18,2)) as collected, cast(0 as decimal(18,2)) as deductible
      from invoices
      union all
      select cast(date_trunc('month', order_date) as date), 0, cast(round(total_amount * 0.19, 2) as decimal(18,2))
      from purchase_orders where status <> 'cancelled')
group by 1""")
def vat_position(db):
    return reports.vat_position(db["invoices"], db["purchase_orders"])


@query("x05_customer_rollups", f"""
select c.id, count(o.id) as total_orders, {total0('o.total_amount')} as total_sales,
       coalesce({average('o.total_amount')}, 0) as average_order_value, max(o.order_date) as last_order_date
from customers c left join sales_orders o on o.customer_id = c.id group by c.id""")
def customer_rollups(db):
    return reports.customer_rollups(db["customers"], db["sales_orders"])


@query("x05_supplier_rollups", f"""
select s.id, count(o.id) as total_orders, {total0('o.total_amount')} as total_purchases
from suppliers s left join purchase_orders o on o.supplier_id = s.id group by s.id""")
def supplier_rollups(db):
    return reports.supplier_rollups(db["suppliers"], db["purchase_orders"])


_CHANGED_ORDERS = """
changed_orders as (
  select id, case when id % 5 = 0 then null else customer_id end as customer_id, total_amount, order_date from sales_orders where status = 'completed'
  union all
  select id, customer_id, cast(total_amount * 2 as decimal(12,2)), order_date from sales_orders where status = 'pending'
  union all
  select -id - 1, customer_id, total_amount, order_date + 30 from sales_orders where status = 'pending' and total_amount < 100000)"""


def changed_orders(orders):
    """Cancelled orders are deleted, some completed ones lose their customer, pending ones double; small pending ones
    are copied a month later. Orders of any other status go too."""
    columns = ["id", "customer_id", "total_amount", "order_date"]
    completed = orders.filter("status = 'completed'").withColumn("customer_id", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("customer_id")))
    pending = orders.filter("status = 'pending'")
    doubled = pending.withColumn("total_amount", (F.col("total_amount") * 2).cast("decimal(12,2)"))
    copies = pending.filter("total_amount < 100000").withColumn("id", -F.col("id") - 1).withColumn("order_date", F.date_add("order_date", 30))
    return completed.select(*columns).unionAll(doubled.select(*columns)).unionAll(copies.select(*columns))


@query("x05_incremental_rollups", f"""
with {_CHANGED_ORDERS}
select c.id, count(o.id) as total_orders, count(o.total_amount) as valued_orders, {total0('o.total_amount')} as total_sales,
       coalesce({average('o.total_amount')}, 0) as average_order_value, max(o.order_date) as last_order_date
from customers c left join changed_orders o on o.customer_id = c.id group by c.id""")
def incremental_rollups(db):
    """The roll-ups of the orders as they were, brought up to date by the changes."""
    old = db["sales_orders"]
    new = changed_orders(old)
    stored = reports.stored_rollups(db["customers"], old)
    return reports.updated_rollups(stored, reports.signed_changes(old, new, "customer_id"), new)

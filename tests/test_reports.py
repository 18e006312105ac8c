"""Report rules on hand-made rows."""

import datetime as dt
from decimal import Decimal as D

from tradeframe.operators import reports

ORDERS = "id long, customer_id long, supplier_id long, order_date date, status string, total_amount decimal(12,2)"


def orders(spark, *rows):
    return spark.createDataFrame([(i, 1, s, dt.date.fromisoformat(d), st, D(a)) for i, s, d, st, a in rows], ORDERS)


def test_supplier_without_orders_in_the_period_vanishes_but_customer_kpis_keep_it(spark):
    suppliers = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    rows = orders(spark, (1, 1, "2024-01-05", "completed", "10"), (2, 2, "2023-01-05", "completed", "10"))
    rows = rows.selectExpr("*", "order_date as actual_delivery_date")
    assert {r["id"] for r in reports.supplier_performance(suppliers, rows).collect()} == {1, 2}
    assert {r["id"] for r in reports.supplier_performance(suppliers, rows, "2024-01-01").collect()} == {1}
    kept = {r["id"]: r for r in reports.supplier_kpis(suppliers, rows, "2024-01-01").collect()}
    assert kept[2]["total_orders"] == 0 and kept[2]["total_spent"] == D("0.00") and kept[2]["last_order_date"] is None


def test_supplier_without_any_order_has_null_sums_and_null_rate(spark):
    suppliers = spark.createDataFrame([(1, "A")], "id long, name string")
    rows = orders(spark, (1, 9, "2024-01-05", "completed", "10")).selectExpr("*", "order_date as actual_delivery_date")
    row = reports.supplier_performance(suppliers, rows).first()
    assert (row["total_orders"], row["total_spent"], row["completion_rate"]) == (0, None, None)


def test_average_rounds_half_up_exactly(spark):
    rows = orders(spark, (1, 1, "2024-01-05", "x", "100.11"), (2, 1, "2024-01-06", "x", "100.12"))
    assert reports.sales_by_month(rows).first()["avg_order_value"] == D("100.12")


def test_statistics_of_nothing_are_null(spark):
    row = reports.order_statistics(orders(spark, (1, 1, "2024-01-05", "pending", "1")), "2030-01-01").first()
    assert (row["total_orders"], row["total_revenue"], row["pending_orders"]) == (0, None, None)


def test_period_ends_at_midnight_for_timestamps(spark):
    rows = spark.sql("""select id, cast(at as timestamp_ntz) order_date, cast(1 as decimal(12,2)) total_amount, 'x' status
                        from values (1, '2024-01-31 00:00:00'), (2, '2024-01-31 10:00:00') t(id, at)""")
    assert reports.order_statistics(rows, None, "2024-01-31").first()["total_orders"] == 1


def test_transfer_lowers_the_net_without_being_an_expense(spark):
    rows = spark.createDataFrame(
        [("income", D("100"), dt.date(2024, 1, 1)), ("transfer", D("30"), dt.date(2024, 1, 2))],
        "type string, amount decimal(18,2), transaction_date date")
    row = reports.cash_flow(rows).first()
    assert (row["income"], row["expense"], row["net"]) == (D("100.00"), D("0.00"), D("70.00"))
    accounts = spark.createDataFrame([(D("5"), True), (D("7"), False)], "balance decimal(18,2), is_active boolean")
    summary = reports.financial_summary(rows, accounts).first()
    assert (summary["net_position"], summary["account_balance"]) == (D("100.00"), D("5.00"))


def test_top_customers_counts_distinct_orders_and_breaks_ties_by_key(spark):
    movements = spark.createDataFrame(
        [(1, "OUT", 10, D("1"), D("5")), (1, "OUT", 10, D("1"), D("5")), (1, "OUT", 11, D("2"), D("5")),
         (1, "IN", 10, D("9"), D("9"))],
        "product_id long, movement_type string, sales_order_id long, quantity decimal(10,2), unit_price decimal(12,2)")
    sales = spark.createDataFrame([(10, 2), (11, 1)], "id long, customer_id long")
    customers = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    rows = reports.top_customers(movements, sales, customers).orderBy("rank").collect()
    assert [(r["customer_id"], r["total_amount"], r["order_count"]) for r in rows] == [
        (1, D("10.00"), 1), (2, D("10.00"), 1)]


def test_rollups_kept_up_by_changes_equal_those_computed_anew(spark):
    import datetime as dt
    import random
    from decimal import Decimal
    r = random.Random(3)
    schema = "id long, customer_id long, total_amount decimal(12,2), order_date date"

    def order(key):
        return (key, r.choice([None, 1, 2, 3, 4]), r.choice([None, Decimal(r.randrange(1, 99999)) / 100]),
                r.choice([None, dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(6))]))

    customers = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    old = {k: order(k) for k in range(60)}
    new = {k: v if r.random() < 0.5 else order(k) for k, v in old.items() if r.random() < 0.8} | {k: order(k) for k in range(100, 110)}
    one, two = (spark.createDataFrame(list(x.values()), schema) for x in (old, new))
    stored = reports.stored_rollups(customers, one)
    found = reports.updated_rollups(stored, reports.signed_changes(one, two, "customer_id"), two)
    columns = found.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, reports.stored_rollups(customers, two).select(*columns).collect()))
    again = reports.updated_rollups(stored, reports.signed_changes(one, one, "customer_id"), one)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, stored.select(*columns).collect()))
    gone = reports.updated_rollups(stored, reports.signed_changes(one, one.limit(0), "customer_id"), one.limit(0)).collect()
    assert {tuple(x)[1:] for x in gone} == {(Decimal("0.00"), 0, 0, Decimal("0.00"), None)}


def test_months_come_newest_first(spark):
    rows = orders(spark, (1, 1, "2024-01-05", "completed", "10"), (2, 1, "2024-03-05", "completed", "10"), (3, 1, "2024-02-05", "completed", "10"))
    assert [r["month"].month for r in reports.sales_by_month(rows).collect()] == [3, 2, 1]

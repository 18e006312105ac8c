"""Documents, pricing, tree, listing and numbers on hand-made rows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tradeframe.functions.keys import document_number
from tradeframe.functions.ranking import line_numbers, newest
from tradeframe.operators import documents, hierarchy, listing, pricing, workflow
from tradeframe.operators.listing import ListSpec, list_rows, select_rows
from tradeframe.plans.listings import saved_search
from tradeframe.session import cut
from tradeframe.sources.seed import seed

ITEM = ("order_id long, product_id long, line_number long, quantity decimal(10,2), unit_price decimal(12,2), "
        "discount_percentage decimal(5,2)")


def items(spark, *rows):
    return spark.createDataFrame([(o, p, n, D(q), D(u), d if d is None else D(d)) for o, p, n, q, u, d in rows], ITEM)


def test_subtotal_ignores_line_discounts_and_rounds_once(spark):
    rows = items(spark, (1, 1, 1, "3", "0.35", "50"), (1, 2, 2, "1.5", "0.33", None))
    t = pricing.document_totals(rows, "order_id", F.lit("10"), F.lit("19")).first()
    # exact: 1.545, 0.1545, 1.3905, 0.264195, 1.654695
    assert tuple(t)[1:] == (D("1.55"), D("0.15"), (D("1.39")), D("0.26"), D("1.65"))


def test_line_total_treats_null_discount_as_none(spark):
    rows = items(spark, (1, 1, 1, "2", "10", None), (1, 1, 2, "2", "10", "12.50"))
    assert [r["line_total"] for r in pricing.priced_lines(rows).orderBy("line_number").collect()] == [D("20.00"), D("17.50")]


def test_movement_value_falls_back_on_zero(spark):
    rows = spark.createDataFrame([(D("0"), D("2"), D("3")), (D("9"), D("2"), D("3")), (None, D("2"), None)],
                                 "total_value decimal(12,2), quantity decimal(10,2), unit_price decimal(12,2)")
    assert [r[0] for r in rows.select(pricing.movement_value()).collect()] == [D("6.00"), D("9.00"), D("0.00")]


def test_new_document_without_items_totals_zero(spark):
    header = spark.createDataFrame([(1, D("0"), D("19")), (2, D("10"), D("0"))],
                                   "id long, discount_percentage decimal(5,2), tax_percentage decimal(5,2)")
    done, lines = pricing.new_document(header, items(spark, (2, 1, 1, "1", "50", None)), "id", "order_id")
    assert {r["id"]: r["total_amount"] for r in done.collect()} == {1: D("0.00"), 2: D("45.00")}
    assert lines.first()["line_total"] == D("50.00")


@pytest.fixture
def shop(spark):
    return {
        "sales_orders": spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, customer_id long"),
        "customers": spark.createDataFrame([(7, "A", None, None, None)],
                                           "id long, name string, email string, phone string, company string"),
        "sales_order_items": items(spark, (1, 1, 2, "1", "1", None), (1, 2, 1, "1", "1", None), (2, 9, 1, "1", "1", None),
                                   *[(2, 1, n, "1", "1", None) for n in range(2, 12)]),
        "products": spark.createDataFrame([(1, "P", "S1", "piece", D("4")), (2, "Q", "S2", "piece", D("5"))],
                                          "id long, name string, sku string, unit string, quantity_in_stock decimal(10,2)"),
    }


def test_documents_have_ordered_items_and_empty_arrays(shop):
    rows = {r["id"]: r for r in documents.documents(shop, documents.SALES_ORDER, 1000).collect()}
    assert [i["line_number"] for i in rows[1]["items"]] == [1, 2]
    assert rows[1]["items"][0]["product_name"] == "Q" and rows[1]["customer_name"] == "A"
    assert rows[3]["items"] == [] and rows[2]["customer_name"] is None


def test_long_documents_come_in_pages_without_loss(shop):
    rows = documents.documents(shop, documents.SALES_ORDER, page_lines=4).filter("id = 2").orderBy("page").collect()
    assert [[i["line_number"] for i in r["items"]] for r in rows] == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11]]


def test_pages_count_items_not_line_numbers(spark, shop):
    far = {**shop, "sales_order_items": items(spark, *[(2, 1, n * 70_000, "1", "1", None) for n in range(1, 6)])}
    rows = documents.documents(far, documents.SALES_ORDER, page_lines=3).filter("id = 2").orderBy("page").collect()
    assert [[i["line_number"] for i in r["items"]] for r in rows] == [[70_000, 140_000, 210_000], [280_000, 350_000]]


def test_only_wanted_documents(spark, shop):
    keys = spark.createDataFrame([(3,)], "id long")
    assert [r["id"] for r in documents.document_lines(shop, documents.SALES_ORDER, keys).collect()] == [3]


FAMILY = "id long, code string, name string, parent_id long, level int, path string, is_active boolean"


def test_inactive_parent_hides_its_subtree(spark):
    rows = spark.createDataFrame(
        [(1, "A", "a", None, 1, "/A", True), (2, "B", "b", 1, 2, None, False), (3, "C", "c", 2, 3, None, True),
         (4, "D", "d", 1, 2, None, True), (5, "E", "e", 77, 2, None, True)], FAMILY)
    tree = {r["id"]: (r["root_id"], r["depth"], r["sort_path"]) for r in hierarchy.reachable_families(rows).collect()}
    assert tree == {1: (1, 1, "A"), 4: (1, 2, "A/D")}
    nested = hierarchy.nested_tree(rows).collect()
    assert [(r["id"], [c["id"] for c in r["children"]]) for r in nested] == [(1, [4])]


def test_a_tree_is_as_deep_as_its_rows(spark):
    rows = spark.createDataFrame([(n, f"c{n}", "x", n - 1 if n > 1 else None, n, None, True) for n in range(1, 6)]
                                 + [(20, "p", "x", 21, 1, None, True), (21, "q", "x", 20, 1, None, True)], FAMILY)
    assert {r["id"]: r["depth"] for r in hierarchy.reachable_families(rows).collect()} == {n: n for n in range(1, 6)}
    node, seen = hierarchy.nested_tree(rows).first(), []
    while node is not None:
        seen.append((node["id"], node["level"]))
        node = node["children"][0] if "children" in node and node["children"] else None
    assert seen == [(n, n) for n in range(1, 6)]
    assert hierarchy.nested_tree(rows.limit(0)).count() == 0


def test_new_families_get_level_and_path_or_are_rejected(spark):
    known = spark.createDataFrame([(1, "A", "a", None, 1, "/A", True)], FAMILY)
    new = spark.createDataFrame([(10, "X", "x", None), (11, "Y", "y", 1), (12, "Z", "z", 11), (13, "Q", "q", 99),
                                 (14, "R", "r", 13)], "id long, code string, name string, parent_id long")
    placed, rejected = hierarchy.place_families(known, new)
    assert {r["id"]: (r["level"], r["path"]) for r in placed.collect()} == {
        10: (1, "/X"), 11: (2, "/A/Y"), 12: (3, "/A/Y/Z")}
    assert sorted(r["id"] for r in rejected.collect()) == [13, 14]


def test_seed_families_without_path_sort_last(spark):
    from tradeframe.operators.hierarchy import families_with_counts
    families = seed(spark)["product_families"].unionByName(
        spark.createDataFrame([(9, "Z", "z", None, 1, "/Z", True)], FAMILY), allowMissingColumns=True)
    products = spark.createDataFrame([(1, 2), (2, 2)], "id long, family_id long")
    spec = ListSpec(lambda db: families_with_counts(db["f"], db["p"]), sort=(("path", "asc"),))
    rows = list_rows(spec, {"f": families, "p": products}).rows.collect()
    assert [r["id"] for r in rows] == [9, 1, 2, 3, 4, 5] and rows[2]["product_count"] == 2


SPEC = ListSpec(lambda db: db["t"], search=("name",), filters={"kind": "kind"}, flags={"low": "n < 3"},
                sortable=("n",), sort=(("name", "desc"),))


@pytest.fixture
def table(spark):
    return {"t": spark.createDataFrame([(1, "Ab", "x", 1), (2, None, "x", 2), (3, "b%", "y", 3), (4, "cb", "y", 2)],
                                       "id long, name string, kind string, n int")}


def test_nulls_are_largest_and_the_key_breaks_ties(table):
    assert [r["id"] for r in list_rows(SPEC, table).rows.collect()] == [2, 4, 3, 1]
    assert [r["id"] for r in list_rows(SPEC, table, sort_by="n", sort_order="asc").rows.collect()] == [1, 2, 4, 3]


def test_total_is_right_on_a_page_past_the_end(table):
    found = list_rows(SPEC, table, page=9, limit=3)
    assert found.rows.count() == 0 and tuple(found.totals.first()) == (4, 2)


@pytest.mark.parametrize("order", [(None, "desc"), ("n", "asc"), ("n", "desc")])
def test_deep_pages_are_located_by_ranges(spark, monkeypatch, order):
    rows = [(i, None if i % 7 == 0 else f"name {i * 37 % 101}", "x", None if i % 5 == 0 else i * 13 % 50) for i in range(600)]
    table = {"t": spark.createDataFrame(rows, "id long, name string, kind string, n int").repartition(5)}
    near = [[r["id"] for r in list_rows(SPEC, table, p, 20, *order).rows.collect()] for p in (1, 7, 15, 30, 31)]
    monkeypatch.setattr(listing, "DEEP", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small: keep its ranges apart
    try:
        far = [[r["id"] for r in list_rows(SPEC, table, p, 20, *order).rows.collect()] for p in (1, 7, 15, 30, 31)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert far == near


def test_search_keeps_wildcards_and_ignores_case(table):
    assert {r["id"] for r in select_rows(SPEC, table, search="B").collect()} == {1, 3, 4}
    assert {r["id"] for r in select_rows(SPEC, table, search="_b").collect()} == {1, 4}


def test_filters_flags_and_unknown_names(table):
    assert {r["id"] for r in select_rows(SPEC, table, kind="y", low=True).collect()} == {4}
    with pytest.raises(ValueError):
        select_rows(SPEC, table, other=1)


def test_saved_search_accepts_only_listed_columns(shop):
    with pytest.raises(ValueError):
        saved_search(shop, "sales_orders", '{"total_amount; drop": 1}')


def test_line_numbers_run_through_blocks(spark):
    rows = spark.range(100).selectExpr("id * 3 as pos", "if(id % 10 < 9, 1, 2) as doc")
    got = line_numbers(rows, "doc", "pos", block=20).collect()
    for doc in (1, 2):
        numbers = [r["line_number"] for r in sorted((r for r in got if r["doc"] == doc), key=lambda r: r["pos"])]
        assert numbers == list(range(1, len(numbers) + 1))


def test_newest_is_limited_before_the_shuffle(spark):
    rows = newest(spark.range(1000).selectExpr("id", "id % 2 as k"), ["k"], [F.col("id").desc()], 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {r["id"] for r in rows.collect()} == {999, 998, 997, 996, 995, 994}


def test_numbers_keep_the_whole_key(spark):
    rows = spark.createDataFrame([(7,), (123456789,)], "id long").select(
        document_number("INV", F.lit("2024-03-05").cast("date"), "id"))
    assert [r[0] for r in rows.collect()] == ["INV-20240305-000007", "INV-20240305-123456789"]


@pytest.mark.parametrize("model, expected", [(1, ["30.03", "70.07"]), (3, ["25.03", "25.03", "25.03", "25.01"])])
def test_instalments_add_up(spark, model, expected):
    order = spark.createDataFrame([(1, dt.date(2024, 1, 31), D("100.10"), model)],
                                  "id long, order_date date, total_amount decimal(12,2), model long")
    rows = workflow.instalments(order, seed(spark)["payment_schedule_models"], "model").rows.orderBy("line_number").collect()
    assert [r["amount"] for r in rows] == [D(e) for e in expected]
    assert rows[1]["due_date"] == dt.date(2024, 3, 1)


def test_orders_without_a_usable_model(spark):
    models = seed(spark)["payment_schedule_models"].unionByName(
        spark.createDataFrame([(9, "Broken", False, "no json", "active")], "id long, name string, is_default boolean, terms string, status string"),
        allowMissingColumns=True)
    orders = spark.createDataFrame([(i, dt.date(2024, 1, 1), D("10"), m) for i, m in ((1, None), (2, 77), (3, 9), (4, 2))],
                                   "id long, order_date date, total_amount decimal(12,2), model long")
    done = workflow.instalments(orders, models, "model")
    assert {(r["order_id"], r["line_number"]): r["amount"] for r in done.rows.collect()} == {
        (1, 1): D("3.00"), (1, 2): D("7.00"), (4, 1): D("5.00"), (4, 2): D("5.00")}
    assert {r["id"]: r["reason"] for r in done.rejected.collect()} == {2: "payment model not found", 3: "payment model has no readable terms"}


def test_earlier_conversions_stay(spark):
    quotes = spark.createDataFrame([(1, 7, "converted", 501, dt.date(2024, 1, 1)), (2, 8, "approved", None, dt.date(2024, 1, 1)), (3, 9, "draft", None, None)],
                                   "id long, customer_id long, status string, converted_to_order long, updated_at date")
    lines = items(spark, (2, 1, 1, "1", "1", None)).withColumnRenamed("order_id", "quote_id")
    after = workflow.convert_quotes(quotes, lines, "2024-02-02", 1000).quotes.collect()
    assert {r["id"]: (r["status"], r["converted_to_order"], r["updated_at"]) for r in after} == {
        1: ("converted", 501, dt.date(2024, 1, 1)), 2: ("converted", 1002, dt.date(2024, 2, 2)), 3: ("draft", None, None)}


def test_shipped_and_delivered_both_subtract(spark):
    products = spark.createDataFrame([(1, D("10")), (2, D("1"))], "id long, quantity_in_stock decimal(10,2)")
    orders = spark.createDataFrame([(5, "SO-5", "pending")], "id long, order_number string, status string")
    events = spark.createDataFrame([(5, "shipped", dt.datetime(2024, 1, 1)), (5, "delivered", dt.datetime(2024, 1, 2)),
                                    (6, "shipped", dt.datetime(2024, 1, 2))], "id long, status string, at timestamp_ntz")
    done = workflow.ship_orders(products, orders, items(spark, (5, 1, 1, "8", "1", None)), events)
    assert {r["id"]: r["quantity_in_stock"] for r in done.products.collect()} == {1: D("-6.00"), 2: D("1.00")}
    assert done.movements.count() == 2 and done.orders.first()["status"] == "delivered"
    assert [r["id"] for r in done.rejected.collect()] == [6]


def test_auto_orders_take_ten_more_and_chosen_products_only(spark):
    products = spark.createDataFrame(
        [(1, "P", "S1", D("3"), D("5"), None, None, 7, False), (2, "Q", "S2", D("3"), D("5"), D("40"), D("2"), 7, True),
         (3, "R", "S3", D("9"), D("5"), None, D("2"), 7, True), (4, "T", "S4", D("0"), D("5"), None, D("1.50"), 8, True)],
        "id long, name string, sku string, quantity_in_stock decimal(10,2), reorder_point decimal(10,2), "
        "reorder_quantity decimal(10,2), last_purchase_price decimal(12,2), default_supplier_id long, is_active boolean")
    done = workflow.auto_orders(products, "2024-01-01", 100)
    assert {(r["order_id"], r["product_id"]): (r["line_number"], r["quantity"], r["unit_price"]) for r in done.items.collect()} == {
        (107, 1): (1, D("12.00"), D("0.00")), (107, 2): (2, D("40.00"), D("2.00")), (108, 4): (1, D("15.00"), D("1.50"))}
    assert {r["id"]: r["total_amount"] for r in done.orders.collect()} == {107: D("80.00"), 108: D("22.50")}
    some = workflow.auto_orders(products, "2024-01-01", 100, spark.createDataFrame([(4,)], "id long"))
    assert [r["id"] for r in some.orders.collect()] == [108]


def test_a_chain_of_a_thousand_families_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(hierarchy, "cut", lambda df: rounds.append(1) or cut(df))
    chain = spark.createDataFrame([(i, f"c{i}", "n", i - 1 if i else None, True) for i in range(1000)],
                                  "id long, code string, name string, parent_id long, is_active boolean")
    found = {r["id"]: r for r in hierarchy.reachable_families(chain).collect()}
    assert len(rounds) <= 12 and len(found) == 1000
    assert found[999]["depth"] == 1000 and found[999]["root_id"] == 0
    assert found[700]["sort_path"] == "/".join(f"c{i}" for i in range(701))


def test_circles_of_parents_are_left_out(spark):
    rows = [(1, "a", "n", None, True), (2, "b", "n", 1, True), (3, "c", "n", 4, True), (4, "d", "n", 3, True), (5, "e", "n", 4, True), (6, "f", "n", 6, True), (7, "g", "n", 2, True)]
    families = spark.createDataFrame(rows, "id long, code string, name string, parent_id long, is_active boolean")
    assert {r["id"]: r["sort_path"] for r in hierarchy.reachable_families(families).collect()} == {1: "a", 2: "a/b", 7: "a/b/g"}
    stored = spark.createDataFrame([(90, 4, "/x/y")], "id long, level int, path string")
    placed, rejected = hierarchy.place_families(stored, families.drop("is_active").unionByName(
        spark.createDataFrame([(8, "h", "n", 90), (9, "i", "n", 8), (10, "j", "n", 99), (11, "k", "n", 10)], "id long, code string, name string, parent_id long")))
    assert {r["id"]: (r["level"], r["path"]) for r in placed.collect()} == {1: (1, "/a"), 2: (2, "/a/b"), 7: (3, "/a/b/g"), 8: (5, "/x/y/h"), 9: (6, "/x/y/h/i")}
    assert {r["id"] for r in rejected.collect()} == {3, 4, 5, 6, 10, 11}

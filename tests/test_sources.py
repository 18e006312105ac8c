"""Schemas, reference rows, snapshots, and the shape of plans."""


import pytest
from pyspark.sql import functions as F

from tradeframe.operators import reports
from tradeframe.operators.integrity import declared_violations
from tradeframe.plans.listings import LISTINGS
from tradeframe.operators.listing import list_rows
from tradeframe.session import shared_folder
from tradeframe.sources import commits, schemas
from tradeframe.sources.seed import seed
from tradeframe.sources.snapshots import read_snapshot, write_snapshot
from tradeframe.sources.tables import append, conform, load, load_given, read_table
from tradeframe.sources.views import BusinessViews

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_schemas_parse_and_references_exist(spark):
    for table in schemas.BUSINESS | schemas.GIVEN:
        assert len(schemas.schema(table)) > 1
    names = {t: set(schemas.schema(t).names) for t in schemas.BUSINESS}
    for child, column, parent in schemas.FOREIGN_KEYS + schemas.CASCADES:
        assert column in names[child] and "id" in names[parent]
    for columns in (schemas.UNIQUE, schemas.REQUIRED, schemas.DEFAULTS):
        for table, listed in columns.items():
            assert set(listed) <= names[table], table


def test_given_tables_have_the_declared_schema(spark):
    for table, df in load_given(spark, SF).items():
        actual = spark.read.parquet(f"{SF}/{table}.parquet").schema
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in actual]


def test_seed_tables_store_and_load(spark):
    folder = shared_folder(spark, "db")
    tables = seed(spark)
    for name, df in tables.items():
        append(df, f"{folder}/{name}")
    stored = load(spark, folder, list(tables))
    assert {n: df.count() for n, df in stored.items()} == {
        "user_roles": 7, "settings": 7, "product_families": 5, "payment_schedule_models": 3, "warehouses": 1}
    assert declared_violations(stored).count() == 0
    assert stored["product_families"].filter("path is not null").count() == 0


def test_views_conform_to_the_schemas(spark):
    db = BusinessViews(spark, SF)
    for table in ("products", "stock_movements", "invoices", "financial_transactions"):
        assert conform(db[table], table).schema.names == schemas.schema(table).names


def test_snapshots_switch_and_are_never_overwritten(spark):
    folder = shared_folder(spark, "snapshots")
    rows = seed(spark)["warehouses"]
    write_snapshot(rows, folder, "warehouses", "v1")
    renamed = read_snapshot(spark, folder, "warehouses").withColumn("name", F.lit("Second"))
    write_snapshot(renamed, folder, "warehouses", "v2", base="v1")
    assert read_snapshot(spark, folder, "warehouses").first()["name"] == "Second"
    with pytest.raises(Exception):
        write_snapshot(rows, folder, "warehouses", "v1", base="v2")
    with pytest.raises(ValueError, match="v2 is current"):
        write_snapshot(rows, folder, "warehouses", "v3", base="v1")


def test_filters_and_columns_reach_the_scan(spark):
    orders = read_table(spark, SF, "orders")
    df = orders.filter(F.col("o_orderstatus") == "F").groupBy("o_custkey").count()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(df)
    sales = plan(reports.sales_by_month(BusinessViews(spark, SF)["sales_orders"]))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in sales


def test_pages_are_a_distributed_top_k(spark):
    rows = list_rows(LISTINGS["sales_orders"], BusinessViews(spark, SF), page=3).rows
    assert "TakeOrderedAndProject" in plan(rows)


def test_no_window_runs_over_a_whole_table(spark):
    from tradeframe.plans.catalogue import load_all
    for name, q in load_all().items():
        if name.startswith(("t0", "w07")):
            continue
        text = q.plan(BusinessViews(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
        for line in text.splitlines():
            if "Window [" in line:
                assert "], [], [" not in line and not line.rstrip().endswith(", []"), (name, line)


def commit_state(spark, root, at=None):
    return {t: sorted(r[0] for r in commits.read(spark, root, t, at).collect()) for t in ("orders", "items")}


def test_several_tables_are_committed_at_once_and_once(spark):
    root = shared_folder(spark, "commits")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert commits.newest(spark, root) == 0
    assert commits.commit(spark, root, "a", 0, whole={"orders": rows(1, 2), "items": rows(10)}) == 1
    for _ in range(2):  # a repeated job adds nothing
        assert commits.commit(spark, root, "b", 1, more={"orders": rows(3), "items": rows(30, 31)}) == 2
    assert commit_state(spark, root) == {"orders": [1, 2, 3], "items": [10, 30, 31]}
    assert [r[0] for r in commits.inserted(spark, root, "orders", "b").collect()] == [3]
    with pytest.raises(ValueError, match="commit 1, but 2"):
        commits.commit(spark, root, "c", 1, whole={"orders": rows(9)})
    assert commits.commit(spark, root, "d", 2, whole={"orders": rows(7)}, more={"items": rows(70)}) == 3
    assert commit_state(spark, root) == {"orders": [7], "items": [10, 30, 31, 70]}
    assert commit_state(spark, root, at=2) == {"orders": [1, 2, 3], "items": [10, 30, 31]}
    with pytest.raises(ValueError, match="not there"):
        commits.read(spark, root, "stock")


def test_a_job_that_dies_between_two_tables_leaves_nothing_to_see(spark):
    root = shared_folder(spark, "commits")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    commits.commit(spark, root, "a", 0, whole={"orders": rows(1), "items": rows(10)})
    broken = rows(30).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, root, "b", 1, more={"orders": rows(3), "items": broken})
    assert commit_state(spark, root) == {"orders": [1], "items": [10]}
    assert commits.commit(spark, root, "b", 1, more={"orders": rows(3), "items": rows(30)}) == 2  # tried again
    assert commit_state(spark, root) == {"orders": [1, 3], "items": [10, 30]}


def test_of_two_writers_one_is_refused(spark, monkeypatch):
    root = shared_folder(spark, "commits")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    commits.commit(spark, root, "a", 0, whole={"orders": rows(1), "items": rows(10)})
    before = commits._log(spark, root)
    assert commits.commit(spark, root, "x", 1, more={"orders": rows(5), "items": rows(50)}) == 2
    seen = iter([before])
    log = commits._log
    monkeypatch.setattr(commits, "_log", lambda spark, root: next(seen, None) or log(spark, root))
    monkeypatch.setattr(commits, "newest", lambda spark, root: 1)  # y has looked before x was there
    with pytest.raises(ValueError, match="another writer"):
        commits.commit(spark, root, "y", 1, more={"orders": rows(6), "items": rows(60)})
    assert commit_state(spark, root) == {"orders": [1, 5], "items": [10, 50]}

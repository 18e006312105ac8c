"""Batch writes: order of updates, idempotence, nothing lost."""

import datetime as dt

from pyspark.sql import functions as F

from tradeframe.operators import integrity, writes
from tradeframe.session import cut

T0 = dt.datetime(2024, 1, 1)
TARGET = "id long, name string, email string, is_active boolean"


def target(spark):
    return spark.createDataFrame([(1, "a", "a@x", True), (2, "b", None, True), (3, "c", "c@x", False)], TARGET)


def updates(spark, *rows):
    return spark.createDataFrame([(k, n, e, T0 + dt.timedelta(hours=h)) for k, n, e, h in rows],
                                 "id long, name string, email string, updated_at timestamp_ntz")


def as_dict(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_null_keeps_and_the_last_value_per_column_wins(spark):
    changed = writes.upsert_coalesce(
        target(spark), updates(spark, (1, "x", None, 1), (1, None, "x@x", 2), (1, "y", None, 3), (9, "z", None, 1)),
        "id", ["name", "email"])
    assert as_dict(changed.table, "name", "email") == {1: ("y", "x@x"), 2: ("b", None), 3: ("c", "c@x")}
    assert as_dict(changed.table, "updated_at")[1] == (T0 + dt.timedelta(hours=3),)
    assert [(r["id"], r["reason"]) for r in changed.rejected.collect()] == [(9, "not found")]


def test_upsert_twice_is_upsert_once(spark):
    batch = updates(spark, (1, "x", None, 1), (2, None, "q", 2))
    once = writes.upsert_coalesce(target(spark), batch, "id", ["name", "email"]).table
    twice = writes.upsert_coalesce(once, batch, "id", ["name", "email"]).table
    assert sorted(map(tuple, once.select(sorted(once.columns)).collect()), key=str) == sorted(
        map(tuple, twice.select(sorted(twice.columns)).collect()), key=str)


def test_kept_and_deleted_make_the_target(spark):
    done = writes.delete_by_key(target(spark), spark.createDataFrame([(1,), (3,), (8,), (1,)], "id long"))
    assert sorted(r["id"] for r in done.kept.collect()) == [2]
    assert sorted(r["id"] for r in done.deleted.collect()) == [1, 3]
    assert [r["id"] for r in done.rejected.collect()] == [8]


def test_own_record_cannot_be_deleted(spark):
    asked = spark.createDataFrame([(1, 1), (2, 1)], "id long, actor long")
    done = writes.delete_by_key(target(spark), asked, actor="actor")
    assert sorted(r["id"] for r in done.deleted.collect()) == [2]
    assert [r["reason"] for r in done.rejected.collect()] == ["cannot delete own record"]


def test_unique_against_table_and_batch(spark):
    batch = spark.createDataFrame([(10, "a", "new"), (11, "n", "m"), (12, "n", "k"), (13, "o", None), (14, "p", None)],
                                  "request long, name string, email string")
    split = writes.check_unique(target(spark), batch, ["name", "email"], "request")
    assert sorted(r["request"] for r in split.accepted.collect()) == [11, 13, 14]
    assert {r["request"]: r["reason"] for r in split.rejected.collect()} == {
        10: "name exists already", 12: "name repeated in the batch"}


def test_a_refused_request_blocks_no_value(spark):
    batch = spark.createDataFrame([(1, "a", "e1"), (2, "n", "e1"), (3, "n", "e2"), (4, "m", "e2"), (5, "m", "e3"), (6, "z", "e3")],
                                  "request long, name string, email string")
    split = writes.check_unique(target(spark), batch, ["name", "email"], "request")
    assert sorted(r["request"] for r in split.accepted.collect()) == [2, 4, 6]
    assert {r["request"]: r["reason"] for r in split.rejected.collect()} == {
        1: "name exists already", 3: "name repeated in the batch", 5: "name repeated in the batch"}


def test_required_and_non_zero(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "", 5), (3, "c", 0)], "id long, name string, amount int")
    split = writes.check_required(rows, ["name", "amount"], non_zero=["amount"])
    assert [r["id"] for r in split.accepted.collect()] == [1]
    assert {r["id"]: r["reason"] for r in split.rejected.collect()} == {2: "name is required", 3: "amount is required"}


def test_status_is_checked_and_missing_status_refused(spark):
    requests = spark.createDataFrame([(1, "paid", T0), (2, None, T0), (3, "lost", T0)],
                                     "id long, status string, updated_at timestamp_ntz")
    rows = target(spark).withColumn("status", F.lit("unpaid"))
    changed = writes.set_status(rows, requests, allowed=["paid", "unpaid"])
    assert as_dict(changed.table, "status") == {1: ("paid",), 2: ("unpaid",), 3: ("unpaid",)}
    assert {r["id"]: r["reason"] for r in changed.rejected.collect()} == {
        2: "status is required", 3: "status must be one of: paid, unpaid"}


def test_soft_delete_keeps_the_row(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    changed = writes.deactivate(target(spark), spark.createDataFrame([(1,)], "id long"), at)
    assert as_dict(changed.table, "is_active") == {1: (False,), 2: (True,), 3: (False,)}


def test_defaults_fill_only_what_is_absent(spark):
    rows = spark.createDataFrame([(1, None), (2, "EUR")], "id long, currency string")
    assert as_dict(writes.with_defaults(rows, "products"), "currency", "tax_rate", "is_active") == {
        1: ("DZD", 19, True), 2: ("EUR", 19, True)}


def test_audit_trail(spark):
    old = target(spark)
    new = spark.createDataFrame([(1, "a", "a@x", True), (2, "b", "b@x", True), (4, "d", None, True)], TARGET)
    rows = {r["record_id"]: r for r in writes.row_changes(old, new, "customers").collect()}
    assert {k: r["action"] for k, r in rows.items()} == {2: "UPDATE", 3: "DELETE", 4: "INSERT"}
    assert rows[2]["changed_columns"] == "email" and rows[3]["new_values"] is None
    assert '"email":"b@x"' in rows[2]["new_values"]


def test_violation_report(spark):
    db = {"users": spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, None, 5)], "id long, username string, role_id long"),
          "user_roles": spark.createDataFrame([(1, "12x"), (2, "7")], "id long, name string")}
    rows = integrity.violations(db, [("users", "role_id", "user_roles")], {"users": ["username"]},
                                {"users": ["username"]}, [("user_roles", "name", "int")])
    assert sorted((r["violation"], r["value"], r["row_count"]) for r in rows.collect()) == [
        ("foreign_key", "5", 2), ("invalid_text", "12x", 1), ("not_null", "3", 1), ("unique", "a", 2)]


def test_violations_scan_each_table_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1, 2), (2, "b", None, 3)], "id long, code string, first long, second long")
    rows.write.parquet(str(tmp_path / "child"))
    rows.select("id").write.parquet(str(tmp_path / "parent"))
    db = {t: spark.read.parquet(str(tmp_path / t)) for t in ("child", "parent")}
    report = integrity.violations(db, [("child", "first", "parent"), ("child", "second", "parent")], {"child": ["code", "second"]},
                                  {"child": ["first", "code"]}, [("child", "code", "int")])
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    assert sorted((r["column_name"], r["violation"], r["value"]) for r in report.collect()) == [
        ("code", "invalid_text", "a"), ("code", "invalid_text", "b"), ("first", "not_null", "2"), ("second", "foreign_key", "3")]


def one_by_one(families, used, requests):
    """The requests in order: what is left, and the reasons."""
    left, reasons = dict(families), {}
    for request, key in sorted(requests):
        if key in used:
            reasons[request] = "family has products"
        elif key in left.values():
            reasons[request] = "family has child families"
        elif key not in left:
            reasons[request] = "not found"
        else:
            del left[key]
    return left, reasons


def check_deletes(spark, families, used, requests):
    done = writes.delete_families_in_order(
        spark.createDataFrame(families, "id long, parent_id long"), spark.createDataFrame([(i, u) for i, u in enumerate([*used, None])], "id long, family_id long"),
        spark.createDataFrame(requests, "request long, id long"))
    left, reasons = one_by_one(families, used, requests)
    assert dict(map(tuple, done.kept.collect())) == left
    assert dict(map(tuple, done.deleted.collect())) == {k: p for k, p in families if k not in left}
    assert {r["request"]: r["reason"] for r in done.rejected.collect()} == reasons
    return left, reasons


def test_a_deleted_child_frees_its_parent_for_later_requests(spark):
    families = [(1, None), (2, 1), (3, 2), (4, 1), (5, None)]
    left, reasons = check_deletes(spark, families, {5}, [(1, 1), (2, 3), (3, 2), (4, 1), (5, 4), (6, 1), (7, 3), (8, 5), (9, 77)])
    assert set(left) == {5}
    assert reasons == {1: "family has child families", 4: "family has child families", 7: "not found", 8: "family has products", 9: "not found"}


def test_deletes_in_random_order(spark):
    import random
    r = random.Random(5)
    families = [(i, r.choice([None, *range(max(0, i - 6), i)]) if i else None) for i in range(60)]
    requests = [(n, r.randrange(64)) for n in range(400)]
    check_deletes(spark, families, {7, 30}, requests)
    check_deletes(spark, families, set(), [])


def test_circles_and_parents_that_do_not_exist(spark):
    families = [(1, 2), (2, 1), (3, 3), (4, 99), (5, 4), (6, 1)]
    left, _ = check_deletes(spark, families, set(), [(n, k) for n, k in enumerate([6, 5, 4, 1, 2, 3, 99])])
    assert set(left) == {1, 2, 3}


def settle(rows):
    taken, accepted = (set(), set()), []
    for key, *values in sorted(rows):
        if not any(v is not None and v in seen for v, seen in zip(values, taken)):
            accepted.append(key)
            for v, seen in zip(values, taken):
                seen.add(v)
    return accepted


def test_a_chain_of_requests_takes_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(writes, "cut", lambda df: calls.append(1) or cut(df))
    chain = [(i, f"n{i // 2}", f"e{(i + 1) // 2}") for i in range(10_000)]  # each shares a value with the one before
    none = spark.createDataFrame([], "name string, email string")
    split = writes.check_unique(none, spark.createDataFrame(chain, "request long, name string, email string"), ["name", "email"], "request")
    assert sorted(r["request"] for r in split.accepted.collect()) == settle(chain) == list(range(0, 10_000, 2))
    assert len(calls) <= 4


def test_rounds_and_order_agree(spark, monkeypatch):
    import random
    r = random.Random(9)
    rows = [(i, r.choice([None, *"abcdefghij"]), r.choice([None, *"klmnopqrstu"])) for i in range(60)]
    frame, none = spark.createDataFrame(rows, "request long, name string, email string"), spark.createDataFrame([], "name string, email string")
    for few in (0, 12, 1000):
        monkeypatch.setattr(writes, "FEW", few)
        split = writes.check_unique(none, frame, ["name", "email"], "request")
        assert sorted(x["request"] for x in split.accepted.collect()) == settle(rows)

"""The ledger against a plain fold, on data where one product owns most of the rows."""

import datetime as dt
import os
import random
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tradeframe.operators import ledger
from tradeframe import session
from tradeframe.plans import stock_queries
from tradeframe.operators.ledger import (APPROVED_BEFORE, INSUFFICIENT, INVALID, NO_MOVEMENT, NOT_FOUND, approve_movements,
                                         ledger_with_approvals, stock_ledger)

MOVES = ("id long, movement_type string, product_id long, quantity decimal(10,2), movement_date date, "
         "is_approved boolean")
DAY = dt.date(2024, 1, 1)


def products(spark, stock):
    return spark.createDataFrame([(k, D(v)) for k, v in stock.items()], "id long, quantity_in_stock decimal(10,2)")


def fold(stock, moves):
    """What the journal must say: id -> (before, after, accepted, reason)."""
    now, out = {k: D(v) for k, v in stock.items()}, {}
    for key, kind, product, quantity, _, approved in sorted(moves, key=lambda m: (m[2] or 0, m[4], m[0])):
        if product not in now:
            out[key] = (None, None, False, NOT_FOUND)
            continue
        before = now[product]
        if kind in ("IN", "RETURN", "ADJUSTMENT"):
            after = before + quantity
        elif kind in ("OUT", "TRANSFER"):
            after = before - quantity if before >= quantity else None
        else:
            out[key] = (before, None, False, INVALID)
            continue
        if after is None:
            out[key] = (before, None, False, INSUFFICIENT)
            continue
        out[key] = (before, after, True, None)
        if approved:
            now[product] = after
    return out, now


def random_moves(seed, n, kinds, hot=0.6, products_=6, largest=50, approved=0.8):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        product = 3 if r.random() < hot else r.randrange(products_)
        rows.append((i, r.choice(kinds), product, D(r.randint(1, largest * 100)) / 100,
                     DAY + dt.timedelta(days=r.randrange(max(n // 20, 1))), r.random() < approved))
    return rows


def check(spark, stock, moves, partitions, **more):
    result = stock_ledger(products(spark, stock), spark.createDataFrame(moves, MOVES), partitions, **more)
    journal = {r["id"]: (r["quantity_before"], r["quantity_after"], r["accepted"], r["reason"])
               for r in result.journal.collect()}
    expected, after = fold(stock, moves)
    assert journal == expected
    assert {r["id"]: r["quantity_in_stock"] for r in result.products.collect()} == after
    return journal


def test_rejection_does_not_count_for_later_movements(spark):
    moves = [(1, "OUT", 1, D("8"), DAY, True), (2, "OUT", 1, D("5"), DAY, True), (3, "OUT", 1, D("2"), DAY, True)]
    journal = check(spark, {1: "10"}, moves, 1)
    assert [journal[k][2] for k in (1, 2, 3)] == [True, False, True]


def test_pending_movement_is_recorded_but_leaves_the_stock(spark):
    moves = [(1, "OUT", 1, D("8"), DAY, False), (2, "OUT", 1, D("9"), DAY, True)]
    journal = check(spark, {1: "10"}, moves, 1)
    assert journal[1][:2] == (D("10.00"), D("2.00")) and journal[2][0] == D("10.00")


def test_negative_adjustment_unknown_type_unknown_product(spark):
    moves = [(1, "ADJUSTMENT", 1, D("-30"), DAY, True), (2, "GIFT", 1, D("1"), DAY, True),
             (3, "IN", 99, D("1"), DAY, True), (4, "OUT", 1, D("1"), DAY, True)]
    journal = check(spark, {1: "10"}, moves, 2)
    assert journal[1][1] == D("-20.00")
    assert [journal[k][3] for k in (2, 3, 4)] == [INVALID, NOT_FOUND, INSUFFICIENT]


@pytest.mark.parametrize("partitions", [1, 7, 40])
@pytest.mark.parametrize("kinds", [("IN", "OUT"), ("IN", "OUT", "OUT", "TRANSFER", "ADJUSTMENT", "GIFT")])
def test_equals_the_plain_fold_with_a_cut_product(spark, partitions, kinds):
    stock = {k: "20.50" for k in range(6)}
    check(spark, stock, random_moves(partitions, 3000, kinds), partitions)


def test_one_product_only(spark):
    check(spark, {3: "500"}, random_moves(5, 2000, ("IN", "OUT", "OUT"), hot=1.0), 25)


def test_no_rejections_at_all(spark):
    check(spark, {k: "1000000" for k in range(6)}, random_moves(6, 2000, ("IN", "OUT")), 25)


def test_stock_so_tight_that_every_stretch_depends_on_the_last(spark):
    """Only takings: the stock never comes back, so every entry stock matters."""
    check(spark, {3: "700"}, random_moves(7, 600, ("OUT",), hot=1.0), 20)


def test_missing_product_key_and_unknown_products_in_between(spark):
    moves = random_moves(8, 800, ("IN", "OUT"))
    moves += [(10_000 + i, "IN", None, D("1"), DAY, True) for i in range(200)]
    check(spark, {3: "10", 5: "10"}, moves, 12)


def test_ledger_invariants(spark):
    moves = random_moves(9, 1500, ("IN", "OUT", "TRANSFER"), approved=1.0)
    rows = stock_ledger(products(spark, {k: "30" for k in range(6)}), spark.createDataFrame(moves, MOVES), 9).journal
    by_product = {}
    for r in sorted(rows.collect(), key=lambda r: (r["product_id"], r["movement_date"], r["id"])):
        sign = 1 if r["movement_type"] == "IN" else -1
        if r["accepted"]:
            assert r["quantity_after"] == r["quantity_before"] + sign * r["quantity"]
            assert sign > 0 or r["quantity_after"] >= 0
        previous = by_product.get(r["product_id"])
        assert previous is None or previous == r["quantity_before"]
        by_product[r["product_id"]] = r["quantity_after"] if r["accepted"] else r["quantity_before"]


def test_approval_sets_the_recorded_stock_and_the_latest_wins(spark):
    moves = spark.createDataFrame(
        [(1, 1, D("5"), D("15"), False), (2, 1, D("3"), D("13"), False), (3, 2, D("1"), D("9"), True)],
        "id long, product_id long, quantity decimal(10,2), quantity_after decimal(10,2), is_approved boolean")
    at = dt.datetime(2024, 1, 1)
    asked = spark.createDataFrame(
        [(2, 7, at), (1, 7, at + dt.timedelta(hours=1)), (3, 7, at), (1, 8, at + dt.timedelta(hours=2)), (50, 7, at)],
        "id long, approved_by long, approved_at timestamp_ntz")
    result = approve_movements(products(spark, {1: "10", 2: "10"}), moves, asked)
    assert {r["id"]: r["quantity_in_stock"] for r in result.products.collect()} == {1: D("15.00"), 2: D("10.00")}
    assert {r["id"]: (r["is_approved"], r["approved_by"]) for r in result.movements.collect()} == {
        1: (True, 7), 2: (True, 7), 3: (True, None)}
    assert Counter((r["id"], r["reason"]) for r in result.rejected.collect()) == Counter(
        [(1, "movement already approved"), (3, "movement already approved"), (50, "movement not found")])


# the way to the result depends on the data, the result does not

def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_products_that_reject_nothing_need_no_python(spark):
    moves = random_moves(6, 2000, ("IN", "OUT", "ADJUSTMENT", "GIFT"))
    stock = {k: "1000000" for k in range(6)}
    check(spark, stock, moves + [(9000, "IN", 77, D("1"), DAY, True), (9001, "IN", None, D("1"), DAY, True)], None)
    result = stock_ledger(products(spark, stock), spark.createDataFrame(moves, MOVES))
    assert "MapInArrow" not in plan_of(result.journal) + plan_of(result.products)


def test_a_day_that_might_run_out_is_folded(spark):
    """5 in, then 5 out, on one day: nothing is rejected, but only the order of the day says so."""
    check(spark, {1: "0", 2: "9"}, [(1, "IN", 1, D("5"), DAY, True), (2, "OUT", 1, D("5"), DAY, True), (3, "OUT", 2, D("4"), DAY, True)], None)


@pytest.mark.parametrize("most", [1_000_000, 150])
def test_all_ways_at_once(spark, most):
    """Product 3 has most movements (cut into stretches where 150 are many); 4 never runs out; 1 and 2 do."""
    stock = {1: "5", 2: "40", 3: "60", 4: "1000000", 5: "0"}
    check(spark, stock, random_moves(21, 1200, ("IN", "OUT", "OUT")), None, most=most)
    check(spark, stock, random_moves(22, 1200, ("IN", "OUT"), hot=0.0) + random_moves(23, 0, ("IN",)), None, most=most)


def test_opening_taken_from_by_negative_amounts(spark):
    moves = [(i, kind, 1, D(q), DAY + dt.timedelta(days=i // 2), True) for i, (kind, q) in enumerate(
        [("ADJUSTMENT", "-30"), ("OUT", "-5"), ("OUT", "3"), ("IN", "50"), ("OUT", "-1"), ("TRANSFER", "12")])]
    check(spark, {1: "10"}, moves, None)
    check(spark, {1: "1000"}, moves, None)


# approvals

ASKED = "id long, movement_id long, approved_at timestamp_ntz"


def fold_with_approvals(stock, moves, asked):
    at = {m[0]: m for m in moves}
    events = [(dt.datetime.combine(m[4], dt.time()), 0, m[0], m) for m in moves] + [(a[2], 1, a[0], a) for a in asked]
    now, recorded, approved = {k: D(v) for k, v in stock.items()}, {}, set()
    journal, judged = {}, {}
    for _, kind, key, e in sorted(events, key=lambda x: x[:3]):
        if kind == 0:
            one, after = fold({k: str(v) for k, v in now.items() if k == e[2]}, [e])
            journal[key] = one[key]
            if one[key][2]:
                recorded[key] = one[key][1]
                if e[5]:
                    now[e[2]], _ = after[e[2]], approved.add(key)
            continue
        m = e[1]
        product = at[m][2] if m in at else None
        before = now.get(product)
        if m in recorded and m not in approved:
            approved.add(m)
            now[product] = recorded[m]
            judged[key] = (before, recorded[m], True, None)
        else:
            judged[key] = (before, None, False, APPROVED_BEFORE if m in approved else NO_MOVEMENT)
    return journal, judged, now, {m: r for m, r in recorded.items() if m not in approved}


def check_approvals(spark, stock, moves, asked, partitions=None, **more):
    result = ledger_with_approvals(products(spark, stock), spark.createDataFrame(moves, MOVES), spark.createDataFrame(asked, ASKED), partitions, **more)
    journal, judged, now, pending = fold_with_approvals(stock, moves, asked)
    assert {r["id"]: (r["quantity_before"], r["quantity_after"], r["accepted"], r["reason"]) for r in result.journal.collect()} == journal
    assert {r["id"]: (r["quantity_before"], r["quantity_after"], r["accepted"], r["reason"]) for r in result.approvals.collect()} == judged
    assert {r["id"]: r["quantity_in_stock"] for r in result.products.collect()} == now
    assert {r["id"]: r["quantity_after"] for r in result.pending.collect()} == pending
    return journal, judged


def day(n, hour=0):
    return dt.datetime.combine(DAY, dt.time(hour)) + dt.timedelta(days=n)


def test_an_approval_overwrites_what_was_posted_since(spark):
    moves = [(1, "IN", 1, D("5"), DAY, False), (2, "OUT", 1, D("8"), DAY + dt.timedelta(days=1), True), (3, "OUT", 1, D("14"), DAY + dt.timedelta(days=3), True)]
    asked = [(50, 1, day(2)), (51, 1, day(4)), (52, 2, day(4)), (53, 99, day(4)), (54, 3, day(0))]
    journal, judged = check_approvals(spark, {1: "10"}, moves, asked)
    assert journal[3] == (D("15.00"), D("1.00"), True, None)
    assert [judged[k][3] for k in (50, 51, 52, 53, 54)] == [None, APPROVED_BEFORE, APPROVED_BEFORE, NO_MOVEMENT, NO_MOVEMENT]


def random_approvals(seed, moves, share=0.6, later=30):
    r = random.Random(seed)
    out = []
    for m in moves:
        for _ in range(r.choice([0, 1, 1, 2]) if r.random() < share else 0):
            out.append((len(out), m[0], day((m[4] - DAY).days + r.randrange(-2, later), r.choice([0, 0, 7]))))
    return out + [(10_000 + i, -1 - i, day(i)) for i in range(5)]


@pytest.mark.parametrize("partitions, most", [(None, 1_000_000), (None, 100), (1, 1), (6, 1), (25, 1)])
@pytest.mark.parametrize("seed, later, approved", [(31, 3, 0.5), (32, 60, 0.9)])
def test_approvals_within_and_across_stretches(spark, partitions, most, seed, later, approved):
    moves = random_moves(seed, 900, ("IN", "OUT", "OUT", "ADJUSTMENT", "GIFT"), approved=approved)
    moves += [(5000 + i, "IN", p, D("2"), DAY, False) for i, p in enumerate([None, 88])]
    check_approvals(spark, {k: "30.50" for k in range(6)}, moves, random_approvals(seed, moves, later=later), partitions, most=most)


def test_a_product_whose_every_movement_waits(spark):
    """No posting moves the stock but approvals do, each with a result from far before."""
    moves = random_moves(41, 400, ("IN", "OUT"), hot=1.0, approved=0.0)
    check_approvals(spark, {3: "100"}, moves, random_approvals(41, moves, share=1.0, later=200), 12)


def test_no_approvals_and_no_movements(spark):
    moves = random_moves(51, 200, ("IN", "OUT"))
    check_approvals(spark, {3: "5"}, moves, [(1, -5, day(1))])
    nothing = spark.createDataFrame([], MOVES)
    result = ledger_with_approvals(products(spark, {3: "5"}), nothing, spark.createDataFrame([], ASKED))
    assert result.journal.count() == result.approvals.count() == result.pending.count() == 0
    assert [tuple(r) for r in result.products.collect()] == [(3, D("5.00"))]


def test_stretches_learn_ranges_of_entry_stock():
    one = ledger.Stretch()
    one.learn(0, 100, 70, 1, 20, 15, None, None)  # takes 30 if it enters with 80 to 114
    assert one.settle(80) and one.closing == 50 and not one.settle(115) and not one.settle(79)
    two = ledger.Stretch()
    two.learn(0, 100, 42, 0, 20, None, None, None)  # an approval sets the stock
    assert two.settle(5000) and two.closing == 42


def test_a_long_journal_has_more_stretches_than_asked_for(spark, monkeypatch):
    """What one task sorts is bounded, however few partitions are asked for."""
    monkeypatch.setattr(ledger, "STRETCH", 100)
    seen = []
    monkeypatch.setattr(ledger, "lay_out", lambda rows, keys, n=None, lay_out=ledger.lay_out: seen.append(n) or lay_out(rows, keys, n))
    check(spark, {k: "25" for k in range(6)}, random_moves(31, 900, ("IN", "OUT", "OUT")), 4)
    assert seen and min(seen) >= 9


def test_products_that_are_folded_are_shuffled_once(spark):
    """Where a product runs out and none has to be cut, no sums are made and the journal's plan has one exchange."""
    moves = random_moves(41, 600, ("IN", "OUT", "OUT")) + [(9_001, "IN", None, D("1"), DAY, True)]
    result = stock_ledger(products(spark, {k: "5" for k in range(6)}), spark.createDataFrame(moves, MOVES))
    plan = result.journal._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    check(spark, {k: "5" for k in range(6)}, moves, None)


def test_a_product_that_comes_twice_is_not_folded_at_once(spark):
    def at_once(stock, most=100):
        rows = spark.createDataFrame([(k, D(v)) for k, v in stock], "id long, quantity_in_stock decimal(10,2)")
        moves = spark.createDataFrame([(1, "OUT", 1, D("5"), DAY, True), (2, "IN", 2, D("5"), DAY, True), (3, "OUT", 7, D("5"), DAY, True)], MOVES)
        return ledger._folded_at_once(ledger._events(moves, ("movement_date", "id")), None, ledger._openings(rows), most)

    assert at_once([(1, "2"), (2, "1")]) and not at_once([(1, "2"), (2, "1")], most=0)
    assert not at_once([(1, "2"), (2, "1"), (2, "1")])
    assert not at_once([(1, "5"), (2, "1")])


def test_requests_are_matched_without_an_aggregation(spark):
    """The first open request of a movement is found where the join has put its requests."""
    moves = [(1, "IN", 1, D("5"), DAY, False), (2, "OUT", 1, D("1"), DAY, True)]
    asked = [(i, m, dt.datetime.combine(DAY, dt.time(12 - i))) for i, m in enumerate([1, 1, 2, None, 77])]
    matched = ledger._matched(spark.createDataFrame(moves, MOVES), spark.createDataFrame(asked, ASKED), ("movement_date", "id"), None, None)
    assert "Aggregate" not in matched._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["_sets"] for r in matched.collect()} == {0: None, 1: 1, 2: None, 3: None, 4: None}


def left_behind(spark, *names):
    """Working copies below the checkpoint folder."""
    session.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {f for f in os.listdir(folder) if f.split("-")[0] in names}


def test_requests_are_folded_in_parts(spark, monkeypatch):
    """Where there are many events a part of the products is shuffled at a time, with the same rows; what was matched does not stay."""
    moves = random_moves(61, 500, ("IN", "OUT", "OUT", "GIFT"), approved=0.6) + [(5000 + i, "IN", p, D("2"), DAY, False) for i, p in enumerate([None, 88])]
    asked = random_approvals(61, moves) + [(20_000, None, day(3)), (20_001, 5000, day(3)), (20_002, 5001, day(3))]
    monkeypatch.setattr(ledger, "WAVE", 100)
    written = []
    monkeypatch.setattr(ledger, "stored", lambda df, path: written.append(path.split("/")[-1].split("-")[0]) or session.stored(df, path))
    before = left_behind(spark, "asked")
    check_approvals(spark, {k: "30.50" for k in range(6)}, moves, asked)
    assert written[0] == "asked" and written[1:] == ["posted"] * 8
    assert left_behind(spark, "asked") == before


def test_an_id_that_comes_twice_takes_the_earlier_way(spark, monkeypatch):
    """A request that finds two movements is one of each, as are the movements with their requests."""
    monkeypatch.setattr(ledger, "_in_parts", None)
    moves = spark.createDataFrame([(1, "IN", 1, D("5"), DAY, False)] * 2 + [(2, "IN", 1, D("5"), DAY, True)], MOVES)
    result = ledger_with_approvals(products(spark, {1: "10"}), moves, spark.createDataFrame([(7, 1, day(1))], ASKED))
    assert Counter(r["id"] for r in result.journal.collect()) == {1: 4, 2: 1}
    assert Counter((r["accepted"], r["reason"]) for r in result.approvals.collect()) == {(True, None): 4, (False, APPROVED_BEFORE): 4}


def test_stored_rows_leave_no_shuffle(spark):
    def shuffles():
        return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    spark._jvm.System.gc()
    rows = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffles()
    for _ in range(5):
        copy = session.stored(rows, session.shared_folder(spark, "rows"))
    assert copy.agg(F.sum("count")).first()[0] == 1000
    assert shuffles() <= before + 2  # of the sum


def test_the_ledger_query_writes_only_what_it_needs(spark, monkeypatch):
    """Prices, orders and people of a movement are not carried through the fold."""
    moves = spark.createDataFrame([(1, "OUT", 1, D("8"), DAY, False, "WH-A", 77, D("1"))], MOVES + ", warehouse string, sales_order_id long, unit_price decimal(10,2)")
    seen = []
    monkeypatch.setattr(ledger, "_in_parts", lambda p, m, *more, made=ledger._in_parts: seen.append(set(m.columns)) or made(p, m, *more))
    rows = stock_queries.ledger_with_approvals({"products": products(spark, {1: "10"}), "stock_movements": moves}).collect()
    assert sorted((r["event"], r["id"], r["accepted"]) for r in rows) == [("approval", 5, True), ("approval", 6, False), ("movement", 1, True)]
    assert seen == [{"id", "movement_type", "product_id", "quantity", "movement_date", "is_approved"}]

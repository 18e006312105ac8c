"""Streams: late events, approvals, restarts, and the same result as the batch jobs."""

import datetime as dt
import os
from decimal import Decimal as D

from tradeframe.operators.ledger import stock_ledger
from tradeframe.session import shared_folder
from tradeframe.operators.ledger import APPROVED_BEFORE, NO_MOVEMENT
from tradeframe.streaming import ledger as ledger_module
from tradeframe.streaming.ledger import LedgerBatches
from tradeframe.plans import stock_queries
from test_ledger import MOVES, check, fold_with_approvals, left_behind, products, random_approvals, random_moves

EVENTS = MOVES + ", approves long"
DAY = dt.date(2024, 1, 1)


def event(key, kind, product, quantity, day, approved=True, approves=None):
    return key, kind, product, None if quantity is None else D(quantity), DAY + dt.timedelta(days=day), approved, approves


def play(spark, stock, batches, levels=None):
    """Run the batches one after the other under one checkpoint, as after restarts."""
    source, out, state = (shared_folder(spark, n) for n in ("events", "out", "state"))
    ledger = LedgerBatches(products(spark, stock), out, partitions=3, levels=levels)
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        ledger.run(spark.readStream.schema(EVENTS).parquet(source), state)
    return ledger


def test_state_back_dated_events_and_approvals(spark):
    ledger = play(spark, {1: "10"}, [
        [event(2, "OUT", 1, "4", 1), event(1, "IN", 1, "1", 0), event(3, "OUT", 1, "5", 2, approved=False),
         event(90, "IN", 55, "1", 0)],
        [event(4, "OUT", 1, "8", 3), event(5, "APPROVE", 1, None, 4, approves=3), event(6, "OUT", 1, "1", 1),
         event(7, "APPROVE", 1, None, 5, approves=3), event(8, "OUT", 1, "2", 6)],
        [event(9, "APPROVE", 1, None, 7, approves=3), event(10, "APPROVE", 1, None, 7, approves=4), event(11, "APPROVE", 1, None, 7, approves=77)],
    ])
    got = {r["id"]: (r["quantity_before"], r["quantity_after"], r["accepted"])
           for rows in (ledger.journal(), ledger.approvals()) for r in rows.collect()}
    assert got == {
        1: (D("10.00"), D("11.00"), True), 2: (D("11.00"), D("7.00"), True),
        3: (D("7.00"), D("2.00"), True), 90: (None, None, False),
        # 6 is dated before 3, which the first batch applied; it takes from the stock of now
        6: (D("7.00"), D("6.00"), True),
        4: (D("6.00"), None, False), 5: (D("6.00"), D("2.00"), True),
        7: (D("2.00"), None, False), 8: (D("2.00"), D("0.00"), True),
        9: (D("0.00"), None, False), 10: (D("0.00"), None, False), 11: (None, None, False)}
    assert {r["id"]: r["reason"] for r in ledger.approvals().filter("not accepted").collect()} == {
        7: APPROVED_BEFORE, 9: APPROVED_BEFORE, 10: NO_MOVEMENT, 11: NO_MOVEMENT}


def test_state_tables_keep_what_changed_and_are_whole_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(ledger_module, "FULL", 3)
    stock = {1: "10", 2: "10", 3: "10"}
    ledger = play(spark, stock, [[event(10 * n, "OUT", 1 + n % 2, "1", n), event(10 * n + 1, "IN", 2, "5", n, approved=False)]
                                 + ([event(10 * n + 2, "APPROVE", 2, None, n, approves=10 * n - 9)] if n > 1 else []) for n in range(5)])
    written = {n: {r["id"] for r in spark.read.parquet(f"{ledger.folder}/stock/epoch={n}").collect()} for n in range(5)}
    assert written == {0: {1, 2, 3}, 1: {2}, 2: {1, 2}, 3: {1, 2, 3}, 4: {1, 2}}
    assert {r["id"] for r in ledger.waiting(4).collect()} == {1, 41}
    before = sorted(map(tuple, ledger.stock(4).collect()))
    batch = spark.read.parquet(f"{ledger.folder}/journal/epoch=4").count()
    # a micro-batch that is repeated after a failure replaces its own result
    again = spark.createDataFrame([event(40, "OUT", 1, "1", 4), event(41, "IN", 2, "5", 4, approved=False), event(42, "APPROVE", 2, None, 4, approves=31)], EVENTS)
    ledger(again, 4)
    assert sorted(map(tuple, ledger.stock(4).collect())) == before and ledger.journal(4).count() == batch
    assert {r["id"]: r["quantity_in_stock"] for r in ledger.stock(-1).collect()} == {k: D(v) for k, v in stock.items()}


def test_random_approvals_in_batches_equal_the_fold(spark):
    """Cut by days, arrival order is the order of time: as the batch ledger over all."""
    moves = random_moves(71, 500, ("IN", "OUT", "OUT"), approved=0.6)
    asked = [(10_000 + a[0], a[1], a[2].replace(hour=0)) for a in random_approvals(71, moves, later=12)]
    stock = {k: "30" for k in range(6)}
    journal, judged, now, pending = fold_with_approvals(stock, moves, asked)
    at = {m[0]: m[2] for m in moves}
    events = [(*m, None) for m in moves] + [(a[0], "APPROVE", at.get(a[1]), None, a[2].date(), True, a[1]) for a in asked]
    cuts = [DAY + dt.timedelta(days=n) for n in (0, 9, 10, 17, 1000)]
    ledger = play(spark, stock, [[e for e in events if low <= e[4] < high] or events[:0] for low, high in zip([DAY - dt.timedelta(days=99)] + cuts[1:-1], cuts[1:])])
    assert {r["id"]: (r["quantity_before"], r["quantity_after"], r["accepted"], r["reason"]) for r in ledger.journal().collect()} == journal
    assert {r["id"]: (r["quantity_after"], r["accepted"], r["reason"]) for r in ledger.approvals().collect()} == {k: v[1:] for k, v in judged.items()}
    assert {r["id"]: r["quantity_in_stock"] for r in ledger.stock(3).collect()} == now
    assert {r["id"]: r["quantity_after"] for r in ledger.waiting(3).collect()} == pending


def test_crossings_alert_once(spark):
    levels = products(spark, {1: "10"}).selectExpr("id", "'P' as name", "true as is_active",
                                                   "cast(5 as decimal(10,2)) as min_stock_level")
    batches = [[event(1, "OUT", 1, "4", 0), event(2, "OUT", 1, "1", 1)], [event(3, "OUT", 1, "1", 2), event(4, "IN", 1, "9", 3)],
               [event(5, "OUT", 1, "10", 4, approved=False)], [event(6, "APPROVE", 1, None, 5, approves=5)]]
    rows = play(spark, {1: "10"}, batches, levels).alerts().collect()
    assert sorted((r["movement_id"], r["quantity_after"], r["shortage"]) for r in rows) == [(2, D("5.00"), D("0.00")), (6, D("3.00"), D("2.00"))]


def test_micro_batches_give_the_batch_ledger(spark):
    stock, moves = {k: "25" for k in range(6)}, sorted(random_moves(11, 900, ("IN", "OUT", "OUT")), key=lambda m: m[4])
    expected = check(spark, stock, moves, 5)
    batches = LedgerBatches(products(spark, stock), shared_folder(spark, "ledger"), partitions=6)
    source, state = shared_folder(spark, "moves"), shared_folder(spark, "state")
    days = sorted({m[4] for m in moves})
    parts = [[m for m in moves if m[4] < days[len(days) // 2]], [m for m in moves if m[4] >= days[len(days) // 2]]]
    for part in parts:
        spark.createDataFrame(part, MOVES).write.mode("append").parquet(source)
        batches.run(spark.readStream.schema(MOVES).parquet(source), state)
    got = {r["id"]: (r["quantity_before"], r["quantity_after"], r["accepted"], r["reason"])
           for r in batches.journal().collect()}
    assert got == expected
    after = stock_ledger(products(spark, stock), spark.createDataFrame(moves, MOVES)).products
    assert {r["id"]: r["quantity_in_stock"] for r in batches.stock(1).collect()} == {
        r["id"]: r["quantity_in_stock"] for r in after.collect()}
    # a micro-batch that is repeated after a failure replaces its own result
    batches(spark.createDataFrame(parts[1], MOVES), 1)
    assert batches.journal().count() == len(moves)


def test_back_dated_movements_are_posted(spark):
    batches = LedgerBatches(products(spark, {1: "5"}), shared_folder(spark, "ledger"), partitions=2)
    batches(spark.createDataFrame([(2, "OUT", 1, D("1"), DAY + dt.timedelta(days=5), True)], MOVES), 0)
    batches(spark.createDataFrame([(1, "OUT", 1, D("1"), DAY, True), (3, "OUT", 1, D("4"), DAY + dt.timedelta(days=6), True)],
                                  MOVES), 1)
    assert {r["id"]: (r["quantity_before"], r["accepted"]) for r in batches.journal().collect()} == {
        2: (D("5.00"), True), 1: (D("4.00"), True), 3: (D("3.00"), False)}
    assert batches.stock(1).first()["quantity_in_stock"] == D("3.00")


def test_a_micro_batch_leaves_no_working_copies(spark):
    copies = "batch", "asked", "posted"
    before = left_behind(spark, *copies)
    ledger = play(spark, {1: "10"}, [[event(1, "OUT", 1, "4", 1, approved=False)], [event(2, "APPROVE", 1, None, 2, approves=1), event(3, "APPROVE", 1, None, 3, approves=1)]])
    assert ledger.plain and ledger.stock(1).first()["quantity_in_stock"] == D("6.00")
    # and with a micro-batch that may not be read twice
    other = LedgerBatches(products(spark, {1: "10"}), shared_folder(spark, "ledger"))
    other(spark.createDataFrame([event(1, "OUT", 1, "4", 1, approved=False), event(2, "APPROVE", 1, None, 2, approves=1)], EVENTS), 0)
    assert not other.plain and other.stock(0).first()["quantity_in_stock"] == D("6.00")
    assert left_behind(spark, *copies) == before


def test_only_rows_as_they_come_are_read_again(spark):
    source = shared_folder(spark, "rows")
    spark.createDataFrame([], EVENTS).write.parquet(source)
    stream = spark.readStream.schema(EVENTS).parquet(source)
    assert ledger_module._is_plain(stream.filter("id > 5").select("id", "approves"))
    assert not ledger_module._is_plain(stream.dropDuplicates(["id"])) and not ledger_module._is_plain(stream.filter("rand() < 0.5"))


def test_files_of_a_micro_batch_go_when_the_next_one_begins(spark):
    rows = spark.createDataFrame([(n, DAY + dt.timedelta(days=n)) for n in range(4)], "id long, movement_date date")
    files, state, out = [], shared_folder(spark, "state"), shared_folder(spark, "out")

    class Db:
        pass

    db = Db()
    db.spark = spark

    def start(stream):
        stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        newest = max((f"{folder}/{f}" for f in left_behind(spark, "events")), key=os.path.getmtime)
        files.append({f for f in os.listdir(newest) if f.endswith(".parquet")})

    stock_queries._replay(db, start, rows, rows["id"] >= 2)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    assert files[0] and not files[0] & files[1]

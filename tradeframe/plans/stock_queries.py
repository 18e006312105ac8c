"""Stock ledger W7, approvals W8, streaming T1-T3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeframe.operators import ledger
from tradeframe.plans.catalogue import query
from tradeframe.plans.report_queries import CASH_FLOW, SALES_BY_MONTH
from tradeframe.session import shared_folder
from tradeframe.streaming.ledger import APPROVE, LedgerBatches
from tradeframe.streaming.rollups import running_cash_flow, running_sales
from tradeframe.streaming.sinks import latest_updates, run_updates

FOLD = """
moves as (
  select m.*, row_number() over (partition by product_id order by movement_date, id) as n,
         case when movement_type in ('IN', 'RETURN', 'ADJUSTMENT') then 1
              when movement_type in ('OUT', 'TRANSFER') then -1 else 0 end as sign
  from stock_movements m),
fold as (
  select id as product_id, cast(0 as bigint) as n, cast(null as bigint) as movement_id,
         cast(null as decimal(18,2)) as before, cast(null as decimal(18,2)) as after, true as ok,
         cast(quantity_in_stock as decimal(18,2)) as stock
  from products
  union all
  select f.product_id, m.n, m.id, f.stock,
         case when m.sign > 0 or (m.sign < 0 and f.stock >= m.quantity) then cast(f.stock + m.sign * m.quantity as decimal(18,2)) end,
         m.sign > 0 or (m.sign < 0 and f.stock >= m.quantity),
         cast(case when m.is_approved and (m.sign > 0 or (m.sign < 0 and f.stock >= m.quantity))
                   then f.stock + m.sign * m.quantity else f.stock end as decimal(18,2))
  from fold f join moves m on m.product_id = f.product_id and m.n = f.n + 1)"""

JOURNAL = f"""
with recursive {FOLD}
select movement_id as id, product_id, before as quantity_before, after as quantity_after, ok as accepted,
       case when not ok then 'insufficient stock' end as reason
from fold where n > 0"""


@query("w07_stock_ledger", JOURNAL)
def stock_ledger(db):
    return ledger.stock_ledger(db["products"], db["stock_movements"]).journal.select(
        "id", "product_id", "quantity_before", "quantity_after", "accepted", "reason")


@query("w07_stock_after", f"""
with recursive {FOLD}
select product_id as id, cast(arg_max(stock, n) as decimal(28,2)) as quantity_in_stock from fold group by 1""")
def stock_after(db):
    return ledger.stock_ledger(db["products"], db["stock_movements"]).products.select("id", "quantity_in_stock")


def recorded(db):
    """Movements with a recorded ``quantity_after`` (the running stock without checks is
    not needed here: the record is whatever the journal says)."""
    return db["stock_movements"].select(
        "id", "product_id", "quantity", "is_approved", "approved_by",
        (F.col("quantity") + F.col("product_id") % 100).cast("decimal(10,2)").alias("quantity_after"),
        F.lit(None).cast("timestamp_ntz").alias("approved_at"))


def approvals(db):
    """A request for every movement, approved already or not; those of one warehouse come
    twice, and for returns there is one that names no movement."""
    rows = db["stock_movements"]
    at = F.col("movement_date").cast("timestamp_ntz")
    first = rows.select("id", F.col("sales_order_id").alias("approved_by"), at.alias("approved_at"))
    again = rows.filter("warehouse = 'WH-A'").select(
        "id", F.col("sales_order_id") + 1, F.date_add("movement_date", 1).cast("timestamp_ntz"))
    unknown = rows.filter("movement_type = 'RETURN'").select(-F.col("id"), F.lit(1).cast("bigint"), at)
    return first.unionAll(again).unionAll(unknown)


_APPROVE = """
recorded as (
  select id, product_id, quantity, is_approved, approved_by,
         cast(quantity + product_id % 100 as decimal(10,2)) as quantity_after
  from stock_movements),
asked as (
  select id, sales_order_id as approved_by, cast(movement_date as timestamp) as approved_at from stock_movements
  union all
  select id, sales_order_id + 1, cast(movement_date + 1 as timestamp) from stock_movements where warehouse = 'WH-A'
  union all
  select -id, 1, cast(movement_date as timestamp) from stock_movements where movement_type = 'RETURN'),
ranked as (select *, row_number() over (partition by id order by approved_at, approved_by) as n from asked),
taken as (select m.*, r.approved_by as new_by, r.approved_at as new_at
          from recorded m join ranked r on r.id = m.id and r.n = 1 where not m.is_approved)"""


@query("w08_approved_movements", f"""
with {_APPROVE}
select m.id, m.product_id, m.quantity, m.quantity_after, m.is_approved or t.id is not null as is_approved,
       coalesce(t.new_by, m.approved_by) as approved_by, t.new_at as approved_at
from recorded m left join taken t on t.id = m.id""")
def approved_movements(db):
    return ledger.approve_movements(db["products"], recorded(db), approvals(db)).movements


@query("w08_stock_after_approval", f"""
with {_APPROVE}
select p.id, cast(coalesce(s.stock, p.quantity_in_stock) as decimal(18,2)) as quantity_in_stock
from products p left join (
  select product_id, quantity_after as stock,
         row_number() over (partition by product_id order by new_at desc, id desc) as n from taken) s
  on s.product_id = p.id and s.n = 1""")
def stock_after_approval(db):
    return ledger.approve_movements(db["products"], recorded(db), approvals(db)).products.select(
        "id", "quantity_in_stock")


@query("w08_rejected_approvals", f"""
with {_APPROVE}
select a.id, case when m.id is null or m.is_approved then count(*) else count(*) - 1 end as requests,
       case when m.id is null then 'movement not found' else 'movement already approved' end as reason
from asked a left join recorded m on m.id = a.id group by a.id, m.id, m.is_approved
having m.id is null or m.is_approved or count(*) > 1""")
def rejected_approvals(db):
    return ledger.approve_movements(db["products"], recorded(db), approvals(db)).rejected


# --- movements and approvals in one order of time ------------------------------------------


def requests(db):
    """Approval requests in time: one for every movement, from a day to three weeks after it (one of a
    large quantity waits longer); movements of warehouse WH-A are asked for twice, and for each return
    there is a request that names no movement."""
    def asked(number, movement, days, when=None):
        row = F.struct((F.col("id") * 4 + number).alias("id"), movement.alias("movement_id"),
                       F.date_add("movement_date", days).cast("timestamp_ntz").alias("approved_at"))
        return row if when is None else F.when(when, row)

    days = (F.abs("quantity") % 20 + 1).cast("int")
    # all requests of a movement from one reading of it
    each = F.array(asked(1, F.col("id"), days), asked(2, F.col("id"), days + 9, F.col("warehouse") == "WH-A"),
                   asked(3, -F.col("id"), days, F.col("movement_type") == "RETURN"))
    rows = db["stock_movements"].select("id", "movement_type", "movement_date", "quantity", "warehouse")
    return rows.select(F.explode(each).alias("_asked")).filter("_asked is not null").select("_asked.*")


def _approvals_sql(slice_of_movement: str, slice_of_request: str) -> str:
    """The sequential fold over movements and approvals, in the order (slice, time, movements first, id). The
    results that wait travel along as a map."""
    days = "cast(abs(quantity) % 20 + 1 as int)"
    return f"""
with recursive posts as (select *, {slice_of_movement} as slice from stock_movements),
asked as (
  select *, {slice_of_request} as slice from (
    select id * 4 + 1 as id, id as movement_id, cast(movement_date + {days} as timestamp) as approved_at from stock_movements
    union all
    select id * 4 + 2, id, cast(movement_date + {days} + 9 as timestamp) from stock_movements where warehouse = 'WH-A'
    union all
    select id * 4 + 3, -id, cast(movement_date + {days} as timestamp) from stock_movements where movement_type = 'RETURN')),
requests as (select a.*, p.product_id from asked a left join posts p on p.id = a.movement_id and p.slice <= a.slice),
events as (
  select 0 as kind, id, product_id, cast(movement_date as timestamp) as moment, slice, quantity, is_approved, cast(null as bigint) as approves,
         case when movement_type in ('IN', 'RETURN', 'ADJUSTMENT') then 1 when movement_type in ('OUT', 'TRANSFER') then -1 else 0 end as sign
  from posts
  union all
  select 1, id, product_id, approved_at, slice, 0, false, movement_id, 0 from requests where product_id is not null),
numbered as (select *, row_number() over (partition by product_id order by slice, moment, kind, id) as n from events),
fold as (
  select id as product_id, cast(0 as bigint) as n, -1 as kind, cast(null as bigint) as id, cast(null as bigint) as approves,
         cast(null as decimal(18,2)) as before, cast(null as decimal(18,2)) as after, true as ok,
         cast(quantity_in_stock as decimal(18,2)) as stock, cast(map([], []) as map(bigint, decimal(18,2))) as waiting
  from products
  union all
  select product_id, n, kind, id, approves, stock, case when ok then after end, ok,
         case when ok and (kind = 1 or is_approved) then after else stock end,
         case when kind = 0 and ok and not is_approved then map_concat(waiting, map([id], [after]))
              when kind = 1 and ok then map_from_entries(list_filter(map_entries(waiting), lambda e: e.key <> approves))
              else waiting end
  from (
    select e.product_id, e.n, e.kind, e.id, e.approves, e.is_approved, f.stock, f.waiting,
           case when e.kind = 1 then f.waiting[e.approves] else cast(f.stock + e.sign * e.quantity as decimal(18,2)) end as after,
           case when e.kind = 1 then map_contains(f.waiting, e.approves) else e.sign > 0 or (e.sign < 0 and f.stock >= e.quantity) end as ok
    from fold f join numbered e on e.product_id = f.product_id and e.n = f.n + 1))
select case f.kind when 0 then 'movement' else 'approval' end as event, f.id, f.product_id, f.before as quantity_before,
       f.after as quantity_after, f.ok as accepted,
       case when f.ok then null when f.kind = 0 then 'insufficient stock'
            when m.ok and m.n < f.n then 'movement already approved' else 'movement not found' end as reason
from fold f left join fold m on f.kind = 1 and m.kind = 0 and m.id = f.approves where f.n > 0
union all
select 'approval', id, null, null, null, false, 'movement not found' from requests where product_id is null"""


def _decided(journal, approvals):
    columns = ["id", "product_id", "quantity_before", "quantity_after", "accepted", "reason"]
    return journal.select(F.lit("movement").alias("event"), *columns).unionByName(
        approvals.select(F.lit("approval").alias("event"), *columns))


@query("w08_ledger_with_approvals", _approvals_sql("0", "0"))
def ledger_with_approvals(db):
    # only what the ledger needs: it writes its movements out
    movements = db["stock_movements"].select("id", "movement_type", "product_id", "quantity", "movement_date", "is_approved")
    posted = ledger.ledger_with_approvals(db["products"], movements, requests(db))
    return _decided(posted.journal, posted.approvals)


# --- streaming ------------------------------------------------------------------------
# The journal arrives in two slices, cut at a day in the middle. Each is written as a
# whole and then processed under the same checkpoint, as by a job that is started twice.


def _middle(movements):
    ends = movements.agg(F.min("movement_date").alias("low"), F.max("movement_date").alias("high")).first()
    return F.lit(ends["low"] + (ends["high"] - ends["low"]) / 2).cast("date")


def _replay(db, start, events, late):
    """Write the events to a source folder, those that are ``late`` after the others, and run ``start`` on
    the stream after each. Files of a micro-batch that is done go when the next one begins."""
    source = shared_folder(db.spark, "events")
    for rows in (events.filter(~late), events.filter(late)):
        rows.write.mode("append").parquet(source)
        start(db.spark.readStream.schema(events.schema).option("cleanSource", "delete").parquet(source))


def _batches(db, levels=None, partitions=None):
    batches = LedgerBatches(db["products"], shared_folder(db.spark, "ledger"), partitions, levels)
    state = shared_folder(db.spark, "state")
    movements = db["stock_movements"]
    _replay(db, lambda stream: batches.run(stream, state), movements, F.col("movement_date") >= _middle(movements))
    return batches


@query("t01_streaming_ledger", JOURNAL)
def streaming_ledger(db):
    return _batches(db).journal().select("id", "product_id", "quantity_before", "quantity_after", "accepted", "reason")


@query("t01_ledger_in_micro_batches", JOURNAL)
def ledger_in_micro_batches(db):
    """As above, with every micro-batch cut into stretches."""
    return _batches(db, partitions=4).journal().select("id", "product_id", "quantity_before", "quantity_after", "accepted", "reason")


@query("t01_stock_in_micro_batches", f"""
with recursive {FOLD}
select product_id as id, cast(arg_max(stock, n) as decimal(28,2)) as quantity_in_stock from fold group by 1""")
def stock_in_micro_batches(db):
    """The stock after the last micro-batch, from the changes that each has written."""
    return _batches(db).stock(1)


_MIDDLE = "(select min(movement_date) + cast(datediff('day', min(movement_date), max(movement_date)) // 2 as int) from stock_movements)"


@query("t01_stream_with_approvals", _approvals_sql(
    f"case when movement_date >= {_MIDDLE} or movement_type = 'RETURN' then 1 else 0 end",
    f"case when approved_at >= {_MIDDLE} then 1 else 0 end"))
def stream_with_approvals(db):
    """Requests for the first half's movements that come in the second; returns are entered in the second half, with the
    dates they had."""
    movements = db["stock_movements"]
    asked = requests(db).select("id", F.lit(APPROVE).alias("movement_type"), F.col("movement_id").alias("approves"),
                                F.col("approved_at").cast("date").alias("movement_date"))
    events = movements.select("id", "movement_type", "product_id", "quantity", "movement_date", "is_approved").unionByName(asked, allowMissingColumns=True)
    batches = LedgerBatches(db["products"], shared_folder(db.spark, "ledger"))
    state = shared_folder(db.spark, "state")
    late = (F.col("movement_date") >= _middle(movements)) | (F.col("movement_type") == "RETURN")
    _replay(db, lambda stream: batches.run(stream, state), events, late)
    return _decided(batches.journal(), batches.approvals())


@query("t02_low_stock_crossings", f"""
with recursive {FOLD}
select f.product_id, p.name, f.movement_id, m.movement_date, before as quantity_before, after as quantity_after,
       p.min_stock_level, cast(p.min_stock_level - after as decimal(18,2)) as shortage
from fold f join products p on p.id = f.product_id join moves m on m.product_id = f.product_id and m.n = f.n
where ok and m.is_approved and p.is_active and before > p.min_stock_level and after <= p.min_stock_level""")
def crossings(db):
    return _batches(db, db["products"]).alerts().drop("epoch")


def _running(db, table: str, report):
    rows = db[table]
    source, out, state = (shared_folder(db.spark, n) for n in ("rows", "report", "state"))
    rows.write.parquet(source)
    stream = db.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(source)
    run_updates(report(stream), out, state)
    return latest_updates(db.spark.read.parquet(out), ["month"])


@query("t03_running_sales", SALES_BY_MONTH)
def running_sales_by_month(db):
    return _running(db, "sales_orders", running_sales)


@query("t03_running_cash_flow", CASH_FLOW)
def running_cash_flow_by_month(db):
    return _running(db, "financial_transactions", running_cash_flow)

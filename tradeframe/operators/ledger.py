"""The stock ledger: which movements are posted, which approvals set the stock, and the stock
before and after each.

A movement out of stock that is not there is rejected and does not count for the ones after it.
A movement that is not approved yet is checked and its result recorded; an approval later sets the
stock to that result, whatever was posted in between. So the stock is a fold over the product's
events in time order, not a running sum. There are three ways to it, all with the same rows:

* **Sums.** A product without approvals that is not out of stock at any day, even if all takings
  of the day came first, rejects nothing: its stock is the sum per day before, and a running sum
  within the day. This is done in DataFrame functions, one task per product and day. It is taken
  when all products are such, or when one has to be cut and such have at least half of the movements.
* **One task per product.** Products are folded in order as their rows stream by: one number
  per product, and the results that wait for an approval. If none has to be cut, all are, after one shuffle.
* **Stretches.** A product with more than ``STRETCH`` events is cut: the journal is range partitioned
  on (product, time, key), and each task owns one contiguous stretch.

What a stretch needs from the ones before it is the stock its first product enters with, and the
results recorded there that it approves. These are settled in rounds: every stretch of a cut product
is folded from assumed values; where they turn out otherwise, it is folded again. What a stretch
makes of its entry stock is known on ranges of it: the entry plus a fixed amount, or a fixed
value once an approval has set the stock to a result from an earlier stretch. Different entry stocks
soon run into the same stock (once a rejection separates them, the smaller is left with what the
larger keeps), so a few rounds are usual. At least one more stretch per product is final after
each round, which makes the result exact in any case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, LongType, StructField, StructType, TimestampNTZType, TimestampType

from tradeframe.functions.money import TOTAL
from tradeframe.session import cut, remove, shared_folder, shuffles_freed, stored

# Movement types by their effect on stock.
ADDING = ("IN", "RETURN", "ADJUSTMENT")
TAKING = ("OUT", "TRANSFER")

NOT_FOUND = "product not found"
INVALID = "invalid movement type"
INSUFFICIENT = "insufficient stock"
NO_MOVEMENT = "movement not found"
APPROVED_BEFORE = "movement already approved"

#: Events of a product, or of a product's day, that one task takes.
STRETCH = 1_000_000
#: Movements and requests that are shuffled to their products at a time, unless that takes more than ``WAVES`` parts.
WAVE, WAVES = 50_000_000, 8


class Ledger(NamedTuple):
    journal: DataFrame    # every movement with before, after, accepted, reason
    products: DataFrame   # the whole product table with its new stock
    approvals: DataFrame | None = None  # every request with before, after, accepted, reason
    pending: DataFrame | None = None    # recorded results that still wait: id, product_id, quantity_after
    copy: str | None = None             # the folder that all of these read; to be removed once they are written


def effect(kind: str = "movement_type") -> Column:
    """1 adds, -1 takes, 0 is not a movement type."""
    return (F.when(F.col(kind).isin(*ADDING), 1).when(F.col(kind).isin(*TAKING), -1).otherwise(0)).cast("int")


def step(stock: int, effect_: int, quantity: int, approved: bool) -> tuple[bool, int, int]:
    """One movement: (accepted, stock after it, stock the next one sees). A movement
    that is not approved yet is checked and recorded but leaves the stock alone."""
    if effect_ == 0 or (effect_ < 0 and stock < quantity):
        return False, stock, stock
    after = stock + effect_ * quantity
    return True, after, after if approved else stock


COLUMNS = ("_product", "_effect", "_units", "_approved", "_opening", "_own", "_sets", "_value")


def _list(column: pa.Array) -> list:
    """As ``to_pylist``, several times as fast for numbers."""
    if column.null_count == len(column):
        return [None] * len(column)
    values = column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False).tolist()
    if column.null_count:
        for i in column.is_null().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
            values[i] = None
    return values


def _columns(batch: pa.RecordBatch, names: tuple[str, ...] = COLUMNS) -> Iterator[tuple]:
    return zip(*[_list(batch.column(batch.schema.get_field_index(n))) for n in names])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches that hold rows of one stretch only, with its number."""
    for batch in batches:
        numbers = _list(batch.column(batch.schema.get_field_index("_chunk")))
        start = 0
        for i in range(1, len(numbers) + 1):
            if i == len(numbers) or numbers[i] != numbers[start]:
                yield numbers[start], batch.slice(start, i - start)
                start = i


def _fold(entries: dict[int, int | None] | None = None) -> Callable:
    """Adds before, after and accepted to rows in order. A product without an opening row, here or
    in an earlier stretch, has no stock and takes no movement. Without ``entries`` no product is cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stock, here = None, None, None
        waiting: dict[int, int] = {}
        for chunk, batch in _chunks(batches) if entries is not None else ((0, b) for b in batches):
            before, after, accepted = [], [], []
            for product, sign, units, approved, opening, own, sets, value in _columns(batch):
                if here != chunk or product != current:
                    stock = entries.get(chunk) if entries is not None and here != chunk else None
                    current, here, waiting = product, chunk, {}
                result, ok = None, False
                if opening is not None:
                    stock = opening
                known = stock
                if stock is not None and opening is None:
                    if sets is None:
                        ok, result, stock = step(stock, sign, units, approved)
                        if ok and own is not None:
                            waiting[own] = result
                    elif (result := waiting.pop(sets, value)) is not None:
                        ok, stock = True, result
                before.append(known)
                after.append(result if ok else None)
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(accepted, pa.bool_())],
                names=batch.schema.names + ["_before", "_after", "accepted"])
    return run


REQUESTS = ("_product", "_opening", "_effect", "_units", "_approved", "_key", "_asks", "_first", "_value")


def _fold_requests(kept: list[str]) -> Callable:
    """As ``_fold`` where no product is cut and no id comes twice, so that a movement's result is found by its id (``_key``)
    in what was accepted before the request (``_asks``). Adds also ``_recorded``: whether it is there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stock = None, None
        results: dict[int, int | None] = {}  # of accepted movements; none where it does not wait
        for batch in batches:
            before, after, accepted, recorded = [], [], [], []
            for product, opening, sign, units, approved, key, asks, first, value in _columns(batch, REQUESTS):
                if product != current:
                    current, stock, results = product, None, {}
                if opening is not None:
                    stock = opening
                known, result, ok, there = stock, None, False, False
                if asks is not None:
                    there = asks in results
                    if first and stock is not None:
                        if (result := results.get(asks)) is None:
                            result = value
                        else:
                            results[asks] = None
                        if result is not None:
                            ok, stock = True, result
                elif stock is not None and opening is None:
                    ok, result, stock = step(stock, sign, units, approved)
                    if ok and key is not None:
                        results[key] = None if approved else result
                before.append(known)
                after.append(result if ok else None)
                accepted.append(ok)
                recorded.append(there)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept]
                + [pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(accepted, pa.bool_()), pa.array(recorded, pa.bool_())],
                names=[*kept, "_before", "_after", "accepted", "_recorded"])
    return run


SUMMARY = ("chunk long, product long, opened long, entry long, closing long, depends long, below long, above long, need long, "
           "total long")


def _summaries(entries: dict[tuple[int, int], int | None]) -> Callable:
    """One row per product of a stretch: whether its opening row is here, the assumed entry stock, the
    closing stock and whether that moves with the entry, how far the entry stock may lie below or above
    the assumed one with the same events being rejected (null: any distance), and, for entries so high
    that nothing is rejected, the least such entry (``need``; null: any) and the total of all movements
    (null if an approval sets the stock)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, current, here = [], None, None
        opened = entry = stock = below = above = need = total = None
        depends = True
        waiting: dict[int, tuple[int, bool]] = {}

        def close() -> None:
            if here is not None:
                rows.append((here, current, opened, entry, stock, int(depends), below, above, need, total))

        for chunk, batch in _chunks(batches):
            for product, sign, units, approved, opening, own, sets, value in _columns(batch):
                if here != chunk or product != current:
                    close()
                    opened = int(opening is not None)
                    entry = stock = opening if opened else entries.get((chunk, product), 0)
                    below = above = need = None
                    total, current, here, depends, waiting = 0, product, chunk, True, {}
                if opening is not None or stock is None:
                    continue
                if sets is not None:
                    result, moves = waiting.pop(sets, (value, False))
                    total = None
                    if result is not None:
                        stock, depends = result, moves
                    continue
                if sign == 0 or not (approved or own is not None):
                    continue
                if sign < 0 and depends:
                    slack = stock - units
                    if slack >= 0:
                        below = slack if below is None else min(below, slack)
                    else:
                        above = -slack if above is None else min(above, -slack)
                if sign < 0 and total is not None:
                    need = units - total if need is None else max(need, units - total)
                ok, result, stock = step(stock, sign, units, approved)
                if approved and total is not None:
                    total += sign * units
                if ok and own is not None:
                    waiting[own] = result, depends
        close()
        fields = [part.split()[0] for part in SUMMARY.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(fields))], names=fields)
    return run


class Stretch:
    """What is known about one product's part of a stretch: ranges of entry stock on
    which the closing stock is the entry plus a fixed amount, or a fixed value."""

    def __init__(self) -> None:
        self.ranges: list[tuple[int | None, int | None, bool, int]] = []
        self.opened = False
        self.closing: int | None = 0

    def learn(self, opened: int, entry: int | None, closing: int | None, depends: int, below: int | None, above: int | None,
              need: int | None, total: int | None) -> None:
        self.opened, self.closing = bool(opened), closing
        if entry is None:
            return
        low = None if below is None else entry - below
        high = None if above is None else entry + above
        self.ranges.append((low, high, bool(depends), closing - entry if depends else closing))
        if total is not None:
            self.ranges.append((need, None, True, total))

    def settle(self, entry: int | None) -> bool:
        """Take the entry stock; false if the closing stock is not known for it yet."""
        if entry is None:
            self.closing = None
            return True
        for low, high, depends, amount in self.ranges:
            if (low is None or low <= entry) and (high is None or entry < high):
                self.closing = entry + amount if depends else amount
                return True
        return False


def _cut_products(laid: DataFrame) -> dict[int, list[int]]:
    """Products that lie in more than one stretch, with their stretches in order. One
    row per stretch comes to the driver, whatever the size of the journal."""
    ends = laid.filter("_product is not null").groupBy("_chunk").agg(
        F.min("_product").alias("low"), F.max("_product").alias("high")).orderBy("_chunk").collect()
    spread: dict[int, list[int]] = {}
    for here, following in zip(ends, ends[1:]):
        if here["high"] == following["low"]:
            spread.setdefault(here["high"], [here["_chunk"]]).append(following["_chunk"])
    return spread


class _Crossing:
    """Results that are recorded in one stretch and approved in a later one. They stay in Spark, as rows
    (``_id``, ``_result``); the driver sees numbers of stretches."""

    def __init__(self, laid: DataFrame, keys: list[str]) -> None:
        made = laid.filter("_own is not null").select(F.col("_own").alias("_id"), F.col("_chunk").alias("_from"))
        used = laid.filter("_sets is not null").select(F.col("_sets").alias("_id"), F.col("_chunk").alias("_to"))
        self.pairs = cut(made.join(used, "_id").filter("_from <> _to"))
        self.keys = keys
        self.makes = {r[0] for r in self.pairs.select("_from").distinct().collect()}
        self.uses = {r[0] for r in self.pairs.select("_to").distinct().collect()}
        self.values: DataFrame | None = None

    def valued(self, rows: DataFrame) -> DataFrame:
        """Rows of some stretches, in order, with the results they take from earlier ones as far as known."""
        if self.values is None:
            return rows
        known = self.values.filter("_result is not null")
        joined = rows.join(known, rows["_sets"] == known["_id"], "left")
        given = [F.coalesce("_value", "_result").alias("_value") if c == "_value" else F.col(c) for c in rows.columns]
        return joined.select(*given).repartition(F.xxhash64("_chunk")).sortWithinPartitions("_chunk", *self.keys)

    def renew(self, folded: DataFrame, chunks: set[int]) -> set[int]:
        """Take the results of stretches that were folded again; stretches that use one that changed."""
        found = folded.filter("_own is not null and _after is not null").select(F.col("_own").alias("_id"), F.col("_after").alias("_result"))
        new = self.pairs.filter(F.col("_from").isin(*chunks)).join(found, "_id", "left").select("_id", "_to", "_from", "_result")
        if self.values is None:
            old = self.pairs.select("_id", "_to", "_from", F.lit(None).cast("long").alias("_result"))
        else:
            old = self.pairs.join(self.values.select("_id", "_result"), "_id").select("_id", "_to", "_from", "_result")
        both = cut(old.filter(~F.col("_from").isin(*chunks)).withColumn("_new", F.col("_result")).unionByName(
            new.join(old.select("_id", F.col("_result").alias("_old")), "_id").select(
                "_id", "_to", "_from", F.col("_old").alias("_result"), F.col("_result").alias("_new"))))
        self.values = both.select("_id", F.col("_new").alias("_result"))
        return {r[0] for r in both.filter(~F.col("_result").eqNullSafe(F.col("_new"))).select("_to").distinct().collect()}


def _settle_entries(laid: DataFrame, spread: dict[int, list[int]], crossing: _Crossing | None = None) -> dict[int, int | None]:
    """Entry stock per stretch whose first product began in an earlier one. The results that cross
    stretches are left settled in ``crossing``."""
    if not spread:
        return {}
    spark = laid.sparkSession
    known = {(c, p): Stretch() for p, chunks in spread.items() for c in chunks}
    entries: dict[tuple[int, int], int | None] = {}
    pending = set(known)
    makes = crossing.makes if crossing else set()
    while pending:
        # the results of a stretch are taken anew together, those of its first and its last product
        pending |= {(c, p) for c, p in known if c in makes and c in {x for x, _ in pending}}
        # at most two rows per stretch: small enough to send to every task
        wanted = F.broadcast(spark.createDataFrame(sorted(pending), "_c long, _p long"))
        rows = laid.select(*laid.columns).join(
            wanted, (F.col("_chunk") == F.col("_c")) & (F.col("_product") == F.col("_p")), "left_semi")
        if crossing:
            rows = crossing.valued(rows.select("_chunk", *COLUMNS, *(k for k in crossing.keys if k != "_product")))
        else:
            rows = rows.select("_chunk", *COLUMNS)
        assumed = dict(entries)
        for r in rows.mapInArrow(_summaries(assumed), SUMMARY).collect():
            stretch = known[r["chunk"], r["product"]]
            if crossing and r["chunk"] in crossing.uses:
                stretch.ranges = []  # learned with other results
            stretch.learn(*r[2:])
        again: set[tuple[int, int]] = set()
        if made := {c for c, _ in pending} & makes:
            fields = StructType([*rows.schema.fields, StructField("_before", LongType()), StructField("_after", LongType()),
                                 StructField("accepted", BooleanType())])
            some = rows.filter(F.col("_chunk").isin(*made))
            # where a stretch begins with the product's opening no entry is needed; else the assumed one
            folded = some.mapInArrow(_fold({c: assumed.get((c, p), 0) for c, p in pending if c != spread[p][0]}), fields)
            changed = crossing.renew(folded, made)
            again |= {(c, p) for c, p in known if c in changed}
        pending = again
        for product, chunks in spread.items():
            if not known[chunks[0], product].opened:
                known[chunks[0], product].closing = None    # not a product
            for before, chunk in zip(chunks, chunks[1:]):
                entry = known[before, product].closing
                # what a stretch hands on as results must be made from the entry it really has
                stale = chunk in makes and entries.get((chunk, product), 0) != entry
                entries[chunk, product] = entry
                if not known[chunk, product].settle(entry) or stale:
                    pending.add((chunk, product))
    return {chunk: stock for (chunk, _), stock in entries.items()}


def _days(column: str, df: DataFrame) -> Column:
    """The block of a row within its product: its day, if the order is by time."""
    kind = df.schema[column].dataType
    return F.to_date(column) if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else F.lit(None).cast("date")


def _events(movements: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return movements.select(
        *movements.columns,
        F.col("product_id").alias("_product"),
        F.lit(1).alias("_rank"),
        F.col(order[0]).alias("_time"),
        F.lit(0).alias("_kind"),
        effect().alias("_effect"),
        (F.col("quantity") * 100).cast("bigint").alias("_units"),
        F.coalesce("is_approved", F.lit(False)).alias("_approved"),
        *(F.lit(None).cast("bigint").alias(c) for c in ("_opening", "_own", "_sets", "_value")),
    )


def _openings(products: DataFrame) -> DataFrame:
    return products.filter("quantity_in_stock is not null").select(
        F.col("id").cast("bigint").alias("_product"), F.lit(0).alias("_rank"),
        (F.col("quantity_in_stock") * 100).cast("bigint").alias("_opening"))


def _keys(order: tuple[str, ...]) -> list[str]:
    return ["_product", "_rank", "_time", "_kind", *order[1:]]


def lay_out(rows: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Events and openings in stretches: range partitioned and sorted, with the number of the stretch.
    The opening stock is a row in front of the product's events, which saves a join that a much-moved
    product would skew. Written out once, because the stretches must stay the same through all rounds."""
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return cut(ranged.sortWithinPartitions(*keys).withColumn("_chunk", F.spark_partition_id().cast("bigint")))


_RESULTS = [StructField("_before", LongType()), StructField("_after", LongType()), StructField("accepted", BooleanType())]


def _result_fields(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, *_RESULTS])


def _by_stretches(rows: DataFrame, keys: list[str], partitions: int | None, approvals: bool) -> DataFrame:
    laid = lay_out(rows, keys, partitions)
    spread = _cut_products(laid)
    crossing = _Crossing(laid, keys) if approvals and spread else None
    if crossing and not crossing.uses:
        crossing = None
    entries = _settle_entries(laid, spread, crossing)
    ordered = crossing.valued(laid) if crossing else laid
    return ordered.mapInArrow(_fold(entries), _result_fields(laid)).drop("_chunk")


def _by_product(rows: DataFrame, keys: list[str]) -> DataFrame:
    # by a hash of its own: an exchange by the column itself is left out over a union that seems to be dealt
    # so already, and when its sides are coalesced the openings end up in other partitions
    # rows without a product go anywhere
    ordered = rows.repartition(F.xxhash64("_product", F.when(F.col("_product").isNull(), F.col("id")))).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_fold(), _result_fields(rows))


def _in_parts(products: DataFrame, movements: DataFrame, asked: DataFrame, order: tuple[str, ...], events: int, path: str) -> DataFrame:
    """Movements and requests folded by product and written to ``path``: after one shuffle, of a part of the products at a
    time if there are many ``events``, so that what is shuffled takes the disk of a part. Columns that can be computed
    are neither shuffled nor written."""
    kind = movements.schema["quantity"].dataType
    whole = isinstance(kind, DecimalType) and kind.scale <= 2 and kind.precision <= 18  # then ``_units`` say it all, and are faster
    moves = movements.select(F.col("product_id").alias("_product"), *[c for c in movements.columns if c != "product_id"], F.lit(0).alias("_kind"))
    requests = asked.select("id", "_movement", "_here", "_there", "_first", "_product", "_time", "_value", F.lit(1).alias("_kind"))
    # an opening has no time, so it comes first
    opened = _openings(products).filter("_product is not null").select("_product", "_opening", F.lit(-1).alias("_kind"))
    rows = moves.unionByName(requests, allowMissingColumns=True).unionByName(opened, allowMissingColumns=True)
    kept = [*(c for c in moves.columns if c != "quantity" or not whole), "_movement", "_here", "_there", "_time", *["_units"] * whole]
    time = F.coalesce("_time", F.when(F.col("_kind") == 0, F.col(order[0]).cast("timestamp_ntz")))
    approved = F.coalesce("is_approved", F.lit(False))
    parts = min(WAVES, events // WAVE + 1)
    for part in range(parts):
        some = rows.filter(F.pmod(F.xxhash64("_product"), F.lit(parts)) == part) if parts > 1 else rows
        dealt = some.repartition(F.xxhash64("_product", F.when(F.col("_product").isNull(), F.col("id"))))
        ready = dealt.select(
            *(c for c in kept if c != "_units"), "_first", "_value", "_opening", effect().alias("_effect"),
            (F.col("quantity") * 100).cast("bigint").alias("_units"), approved.alias("_approved"),
            F.when(F.col("_kind") == 0, F.col("id")).alias("_key"), F.when(F.col("_there"), F.col("_movement")).alias("_asks"),
        ).sortWithinPartitions("_product", time, "_kind", *order[1:])
        fields = StructType([*ready.select(*kept).schema.fields, *_RESULTS, StructField("_recorded", BooleanType())])
        out = stored(ready.mapInArrow(_fold_requests(kept), fields).filter("_kind >= 0"), path)
    found = out.withColumns({"_time": time, "_effect": effect(), "_approved": approved,
                             "product_id": F.col("_product").cast(movements.schema["product_id"].dataType)})
    return found.withColumn("quantity", (F.col("_units").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(kind)) if whole else found


def _day_sums(moves: DataFrame, openings: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Per product and day: events, the stock at its start if nothing is rejected, and what remains of
    that after all takings of the day."""
    change = F.when(F.col("_approved"), F.col("_effect") * F.col("_units")).otherwise(0)
    days = moves.withColumn("_day", _days(order[0], moves)).groupBy("_product", "_day").agg(
        F.count("*").alias("n"), F.sum(change).alias("net"), F.sum(F.least(change, F.lit(0))).alias("taken"))
    so_far = Window.partitionBy("_product").orderBy("_day")  # as many rows as the product has days
    before = F.coalesce(F.sum("net").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = openings.select("_product", F.col("_opening").alias("_from"))
    return days.join(opened, "_product", "left").select(
        "_product", "_day", "n", (F.col("_from") + before).alias("_start"), (F.col("_from") + before + F.col("taken")).alias("_least"))


def _by_sums(moves: DataFrame, days: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Movements of products that reject nothing, or that are unknown."""
    rows = moves.withColumn("_day", _days(order[0], moves))
    starts = days.select(F.col("_product").alias("_p"), F.col("_day").alias("_d"), "_start")
    joined = rows.join(starts, (F.col("_product") == F.col("_p")) & F.col("_day").eqNullSafe(F.col("_d")), "left")
    within = Window.partitionBy("_product", "_day").orderBy(*_keys(order)[2:]).rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("_approved"), F.col("_effect") * F.col("_units")).otherwise(0)
    before = F.col("_start") + F.coalesce(F.sum(change).over(within), F.lit(0))
    ok = F.col("_before").isNotNull() & ((F.col("_effect") > 0) | ((F.col("_effect") < 0) & (F.col("_before") >= F.col("_units"))))
    return joined.withColumn("_before", before.cast("bigint")).withColumn("accepted", ok).select(
        *moves.columns, "_before", F.when(F.col("accepted"), F.col("_before") + F.col("_effect") * F.col("_units")).alias("_after"), "accepted")


def _folded_at_once(moves: DataFrame, asked: DataFrame | None, openings: DataFrame, most: int) -> int:
    """How many events there are, if no product has to be cut and some have to be folded: those with requests, and those
    whose movements take more in all than was there; else 0. Rows of a product that comes twice are left to the other ways."""
    narrow = moves.select("_product", F.when(F.col("_approved"), F.col("_effect") * F.col("_units")).otherwise(0).alias("_change"), F.lit(False).alias("_asked"))
    if asked is not None:
        narrow = narrow.union(asked.select("_product", F.lit(0).cast("bigint"), F.lit(True)))
    # the opening is a row among the others, which saves a join
    narrow = narrow.withColumn("_event", F.lit(1)).union(openings.select("_product", "_opening", F.lit(False), F.lit(0)))
    each = narrow.filter("_product is not null").groupBy("_product").agg(
        F.sum("_event").alias("n"), F.sum("_change").alias("left"), F.bool_or("_asked").alias("asked"), F.sum(1 - F.col("_event")).alias("openings"))
    with shuffles_freed(moves.sparkSession):
        found = each.agg(F.max("n").alias("n"), F.max("openings").alias("openings"), F.sum("n").alias("events"),
                         F.bool_or(F.col("asked") | ((F.col("left") < 0) & (F.col("openings") > 0))).alias("folds")).first()
    return found["events"] if found["folds"] and found["n"] <= most and found["openings"] <= 1 else 0


def _posted(products: DataFrame, moves: DataFrame, asked: DataFrame | None, order: tuple[str, ...], partitions: int | None, most: int,
            at_once: bool) -> DataFrame:
    """All events with ``_before``, ``_after`` and ``accepted``."""
    keys, openings = _keys(order), _openings(products)
    events = moves if asked is None else moves.unionByName(asked, allowMissingColumns=True)
    if at_once:
        opened = openings.filter("_product is not null")
        return _by_product(events.unionByName(opened, allowMissingColumns=True), keys).filter("_opening is null")
    nameless = events.filter("_product is null").select(
        "*", F.lit(None).cast("bigint").alias("_before"), F.lit(None).cast("bigint").alias("_after"), F.lit(False).alias("accepted"))
    events, moves = events.filter("_product is not null"), moves.filter("_product is not null")
    if partitions:
        # a task sorts a stretch, so there are more of them where the journal is long
        found = _by_stretches(events.unionByName(openings, allowMissingColumns=True), keys, max(partitions, events.count() // STRETCH + 1), asked is not None)
        return found.filter("_opening is null").unionByName(nameless)
    days = _day_sums(moves, openings, order)
    kinds = days.groupBy("_product").agg(
        F.sum("n").alias("n"), (F.first("_start").isNull() | ((F.min("_least") >= 0) & (F.max("n") <= most))).alias("sums"))
    if asked is not None:
        requests = asked.filter("_product is not null").groupBy("_product").agg(F.count("*").alias("requests"))
        kinds = kinds.join(requests, "_product", "full").select(
            "_product", (F.coalesce("n", F.lit(0)) + F.coalesce("requests", F.lit(0))).alias("n"),
            (F.col("sums") & F.col("requests").isNull()).alias("sums")).fillna(False, ["sums"])
    kinds = cut(kinds)
    easy, others, large = kinds.agg(F.sum(F.when(F.col("sums"), F.col("n"))), F.sum(F.when(~F.col("sums"), F.col("n"))),
                                    F.count_if(~F.col("sums") & (F.col("n") > most))).first()
    out = nameless
    rest, opened = events, openings
    if (easy or 0) >= (others or 0):
        chosen = kinds.filter("sums").select("_product")
        out = out.unionByName(_by_sums(moves.join(chosen, "_product", "left_semi").select(*moves.columns), days, order), allowMissingColumns=True)
        rest, opened = (df.join(chosen, "_product", "left_anti").select(*df.columns) for df in (events, openings))
        if not others:
            return out
    if large:
        much = kinds.filter(~F.col("sums") & (F.col("n") > most)).select("_product")
        parts = [df.join(much, "_product", "left_semi").select(*df.columns) for df in (rest, opened)]
        found = _by_stretches(parts[0].unionByName(parts[1], allowMissingColumns=True), keys, others // most + 1, asked is not None)
        out = out.unionByName(found.filter("_opening is null"), allowMissingColumns=True)
        rest, opened = (df.join(much, "_product", "left_anti").select(*df.columns) for df in (rest, opened))
    found = _by_product(rest.unionByName(opened, allowMissingColumns=True), keys).filter("_opening is null")
    return out.unionByName(found, allowMissingColumns=True)


def quantity(hundredths: str) -> Column:
    return (F.col(hundredths).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def _journal(posted: DataFrame, columns: list[str]) -> DataFrame:
    reason = (
        F.when(F.col("accepted"), None).when(F.col("_before").isNull(), NOT_FOUND)
        .when(F.col("_effect") == 0, INVALID).otherwise(INSUFFICIENT)
    )
    return posted.select(*columns, quantity("_before").alias("quantity_before"), quantity("_after").alias("quantity_after"),
                         "accepted", reason.alias("reason"))


def stock_ledger(products: DataFrame, movements: DataFrame, partitions: int | None = None,
                 order: tuple[str, ...] = ("movement_date", "id"), most: int = STRETCH) -> Ledger:
    """Post movements (``id, movement_type, product_id, quantity, movement_date,
    is_approved``, further columns are kept) against the products' stock.

    IN, RETURN and ADJUSTMENT add; OUT and TRANSFER need enough stock. The sign of the
    quantity is not checked. ``most`` events of a product are one task's, a product with more is cut into
    stretches; with ``partitions`` the whole journal is cut into that many, or into more of ``STRETCH`` events."""
    moves = _events(movements, order)
    at_once = not partitions and _folded_at_once(moves, None, _openings(products), most) > 0
    posted = _posted(products, moves, None, order, partitions, most, at_once)
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    moved = posted.filter("accepted and _approved").groupBy(F.col("_product").alias("_moved_product")).agg(
        F.sum((F.col("_effect") * F.col("_units")).cast("decimal(20,0)")).alias("_moved"))
    after = products.join(moved, F.col("id") == F.col("_moved_product"), "left").select(
        *[c for c in products.columns if c != "quantity_in_stock"],
        (F.col("quantity_in_stock") + F.coalesce(F.col("_moved") * hundredth, F.lit(0).cast("decimal(10,2)")))
        .cast(TOTAL).alias("quantity_in_stock"))
    return Ledger(_journal(posted, movements.columns), after)


def _matched(movements: DataFrame, approvals: DataFrame, order: tuple[str, ...], waiting: DataFrame | None, settled: DataFrame | None) -> DataFrame:
    """Requests with what is known of their movement before anything is posted: ``_product``, ``_here`` (among
    ``movements``), ``_there`` (posted before the request), ``_sets``: its id, for the first of the requests that find it there
    and not approved, and ``_twice``: whether its id, or that of this request, comes twice."""
    at = F.col(order[0]).cast("timestamp_ntz")
    nothing = F.lit(None)
    known = movements.select(F.col("id").alias("_m"), F.col("product_id").alias("_product"), at.alias("_since"), F.lit(True).alias("_here"),
                             F.coalesce("is_approved", F.lit(False)).alias("_was"), nothing.cast("bigint").alias("_value"), F.lit(True).alias("_kept"))
    if waiting is not None:
        known = known.union(waiting.select(
            F.col("id").alias("_m"), F.col("product_id").alias("_product"), nothing.cast("timestamp_ntz").alias("_since"),
            F.lit(False).alias("_here"), F.lit(False).alias("_was"), (F.col("quantity_after") * 100).cast("bigint").alias("_value"), F.lit(True)))
    if settled is not None:
        known = known.union(settled.select(
            F.col("id").alias("_m"), F.col("product_id").alias("_product"), nothing.cast("timestamp_ntz").alias("_since"),
            F.lit(False).alias("_here"), F.lit(True).alias("_was"), nothing.cast("bigint").alias("_value"), F.col("accepted")))
    # these windows are by the columns of the join, so the rows stay where they are
    known = known.filter("_m is not null").withColumn("_copies", F.sum(F.col("_here").cast("int")).over(Window.partitionBy("_m")))
    requests = approvals.select(F.col("id"), F.col("movement_id").alias("_movement"), F.col("approved_at").cast("timestamp_ntz").alias("_time"))
    since = F.col("_since").isNull() | (F.col("_time") >= F.col("_since"))
    joined = requests.join(known, F.col("_movement") == F.col("_m"), "left").withColumn("_there", F.col("_m").isNotNull() & since & F.col("_kept"))
    opened = joined.withColumn("_open", F.col("_there") & ~F.col("_was"))
    same = Window.partitionBy("_movement")
    first = F.min(F.when(F.col("_open"), F.struct("_time", "id"))).over(same)
    is_first = F.col("_open") & (F.struct("_time", "id") == F.col("_first"))
    sets = opened.withColumn("_first", first).withColumn("_sets", F.when(is_first, F.col("_m")))
    twice = (F.col("_copies") > 1) | (F.count(F.when(F.col("_here"), F.col("_sets"))).over(same) > 1)
    return sets.select("id", "_movement", "_time", "_product", "_here", "_there", "_sets", "_value", F.coalesce(twice, F.lit(False)).alias("_twice"))


def ledger_with_approvals(products: DataFrame, movements: DataFrame, approvals: DataFrame, partitions: int | None = None,
                          order: tuple[str, ...] = ("movement_date", "id"), waiting: DataFrame | None = None,
                          settled: DataFrame | None = None, most: int = STRETCH) -> Ledger:
    """Post movements and approvals (``id, movement_id, approved_at``) in one order of time; at the same time
    movements come first, then by ``id``, which is unique in each table.

    An approval sets the stock to the result that was recorded when its movement was posted, whatever
    has been posted since. It is refused if its movement is not there yet, was rejected, or is approved
    already. ``waiting`` (``id, product_id, quantity_after``) are results recorded earlier, ``settled``
    (``id, product_id, accepted``) movements posted earlier whose result does not wait."""
    spark, openings = movements.sparkSession, _openings(products)
    asked_at, posted_at = shared_folder(spark, "asked"), shared_folder(spark, "posted")
    matched = _matched(movements, approvals, order, waiting, settled)
    asked = stored(matched.withColumn("_first", F.col("_sets").isNotNull()).drop("_sets"), asked_at)
    plain = _events(movements, order).withColumn("_time", F.col(order[0]).cast("timestamp_ntz"))
    events = 0 if partitions else _folded_at_once(plain, asked, openings, most)
    if events and asked.filter("_twice").isEmpty():
        posted = _in_parts(products, movements, asked, order, events, posted_at)
        made, decided = posted.filter("_kind = 0"), posted.filter("_kind = 1")
    else:
        sets = F.when(F.col("_first"), F.col("_movement")).alias("_sets")
        owners = asked.filter("_here and _first").select(F.col("_movement").alias("_o"))
        moves = plain.join(owners, (F.col("id") == F.col("_o")) & ~F.col("_approved"), "left").select(
            *[F.col("_o").alias("_own") if c == "_own" else F.col(c) for c in plain.columns])
        requests = asked.select(
            "id", "_movement", "_here", "_there", "_product", F.lit(1).alias("_rank"), "_time", F.lit(1).alias("_kind"), F.lit(0).alias("_effect"),
            F.lit(0).cast("bigint").alias("_units"), F.lit(False).alias("_approved"), F.lit(None).cast("bigint").alias("_opening"),
            F.lit(None).cast("bigint").alias("_own"), sets, "_value")
        done_with = ("_rank", "_opening", "_own", "_sets", "_value", "_units")
        posted = stored(_posted(products, moves, requests, order, partitions, most, events > 0).drop(*done_with), posted_at)
        made = posted.filter("_kind = 0")
        recorded = made.filter("accepted").select(F.col("id").alias("_r"), F.lit(True).alias("_recorded"))
        decided = posted.filter("_kind = 1").join(recorded, F.col("_movement") == F.col("_r"), "left")
    remove(spark, asked_at)
    there = F.col("_there") & (~F.col("_here") | F.coalesce("_recorded", F.lit(False)))
    judged = decided.select(
        "id", F.col("_movement").alias("movement_id"), F.col("_product").alias("product_id"), F.col("_time").alias("approved_at"),
        quantity("_before").alias("quantity_before"), quantity("_after").alias("quantity_after"), "accepted",
        F.when(F.col("accepted"), None).when(F.coalesce(there, F.lit(False)), APPROVED_BEFORE).otherwise(NO_MOVEMENT).alias("reason"))
    last = posted.filter("_before is not null").groupBy(F.col("_product").alias("_last_product")).agg(F.max_by(
        F.struct(F.when(F.col("accepted") & (F.col("_approved") | (F.col("_kind") == 1)), F.col("_after")).otherwise(F.col("_before")).alias("stock")),
        F.struct("_time", "_kind", *order[1:])).alias("_last"))
    after = products.join(last, F.col("id") == F.col("_last_product"), "left").withColumn("_stock", F.col("_last.stock")).select(
        *[c for c in products.columns if c != "quantity_in_stock"],
        F.coalesce(quantity("_stock").cast(TOTAL), F.col("quantity_in_stock").cast(TOTAL)).alias("quantity_in_stock"))
    done = posted.filter("_kind = 1 and accepted").select(F.col("_movement").alias("_done"))
    open_ = made.filter("accepted and not _approved").select("id", "product_id", quantity("_after").alias("quantity_after"))
    if waiting is not None:
        open_ = open_.unionByName(waiting.select("id", "product_id", F.col("quantity_after").cast("decimal(18,2)").alias("quantity_after")))
    pending = open_.join(done, F.col("id") == F.col("_done"), "left_anti")
    return Ledger(_journal(made, movements.columns), after, judged, pending, posted_at)


class Approved(NamedTuple):
    movements: DataFrame
    products: DataFrame
    rejected: DataFrame


def approve_movements(products: DataFrame, movements: DataFrame, requests: DataFrame) -> Approved:
    """Approve recorded movements (requests ``id, approved_by, approved_at``).

    The stock becomes the movement's recorded ``quantity_after``, whatever happened in
    between: of several approvals for a product the latest decides. An unknown or
    already approved movement is rejected, and so is a second request for one."""
    asked = requests.groupBy(F.col("id").alias("_request")).agg(
        F.min(F.struct("approved_at", "approved_by")).alias("_first"), F.count(F.lit(1)).alias("_times"))
    joined = movements.join(asked, F.col("id") == F.col("_request"), "left")
    takes = F.col("_request").isNotNull() & ~F.col("is_approved")
    table = joined.select(
        *[c for c in movements.columns if c not in ("is_approved", "approved_by", "approved_at")],
        (F.col("is_approved") | takes).alias("is_approved"),
        F.when(takes, F.col("_first.approved_by")).otherwise(
            F.col("approved_by") if "approved_by" in movements.columns else F.lit(None).cast("bigint"))
        .alias("approved_by"),
        F.when(takes, F.col("_first.approved_at")).otherwise(
            F.col("approved_at") if "approved_at" in movements.columns else F.lit(None).cast("timestamp_ntz"))
        .alias("approved_at"),
    )
    latest = joined.filter(takes).groupBy(F.col("product_id").alias("_product")).agg(
        F.max_by("quantity_after", F.struct("_first.approved_at", "id")).alias("_stock"))
    stock = products.join(latest, F.col("id") == F.col("_product"), "left").select(
        *[c for c in products.columns if c != "quantity_in_stock"],
        F.coalesce(F.col("_stock").cast("decimal(18,2)"), F.col("quantity_in_stock").cast("decimal(18,2)"))
        .alias("quantity_in_stock"))
    states = movements.select(F.col("id").alias("_id"), F.col("is_approved").alias("_was"))
    judged = asked.join(states, F.col("_request") == F.col("_id"), "left")
    refused = F.when(F.col("_id").isNull(), F.lit("movement not found")).when(
        F.col("_was") | (F.col("_times") > 1), F.lit("movement already approved"))
    accepted_once = F.when(F.col("_id").isNotNull() & ~F.col("_was"), 1).otherwise(0)
    rejected = judged.withColumn("reason", refused).filter("reason is not null").select(
        F.col("_request").alias("id"), (F.col("_times") - accepted_once).alias("requests"), "reason")
    return Approved(table, stock, rejected)

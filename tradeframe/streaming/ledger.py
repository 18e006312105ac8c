"""The stock ledger on a stream of events.

Events are posted as they arrive: one micro-batch after the other, and inside a micro-batch in
(date, id) order, movements before approvals. A movement dated before others that are posted already is
posted now, on the stock of now; nothing is late, as for a user who enters a date in the past.

``LedgerBatches`` runs the batch ledger on each micro-batch, so a product that fills a micro-batch is
cut like any other. What one micro-batch leaves to the next is kept in two tables beside the
journal: the stock of each product, and the recorded results that wait for an approval. A
micro-batch writes what it changed; every ``FULL`` micro-batches the whole table is written, so a
read has a bounded number of versions to look at. Results that are never approved stay in the table,
not in the memory of a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.operators.ledger import Ledger, ledger_with_approvals, stock_ledger
from tradeframe.session import remove, shared_folder, shuffles_freed, stored
from tradeframe.streaming.alerts import low_stock_crossings

APPROVE = "APPROVE"
FULL = 16
_STOCK = "id long, quantity_in_stock decimal(28,2), epoch int"
_WAITING = "id long, product_id long, quantity_after decimal(18,2), open boolean, epoch int"


def _is_plain(events: DataFrame) -> bool:
    """Whether a stream is its source's rows as they come, or some of them: a micro-batch that is read again is the same
    then and costs no more than a copy."""
    def plain(node) -> bool:
        below = node.children()
        return node.getClass().getSimpleName() in ("Project", "Filter", "StreamingRelation") and all(plain(below.apply(i)) for i in range(below.size()))

    plan = events._jdf.queryExecution().analyzed()
    return plan.deterministic() and plain(plan)


class LedgerBatches:
    """A ``foreachBatch`` function. It posts each micro-batch of movements and, if the stream has a column
    ``approves``, of approvals (``movement_type`` ``APPROVE``, the movement's id in ``approves``, its date in
    ``movement_date``), and writes per epoch below ``folder``: journal, decided approvals, changed
    stock, changed waiting results, and with ``levels`` (products with ``name``, ``is_active`` and
    ``min_stock_level``) the low-stock alerts. Every epoch has its own folders and is rewritten as a whole,
    so a repeated micro-batch leaves the same result."""

    def __init__(self, products: DataFrame, folder: str, partitions: int | None = None, levels: DataFrame | None = None):
        self.products = products
        self.folder = folder
        self.partitions = partitions
        self.levels = levels
        self.plain = False  # whether a micro-batch may be read again
        self.spark = products.sparkSession

    def _write(self, df: DataFrame, table: str, epoch: int) -> None:
        with shuffles_freed(df.sparkSession):
            df.write.mode("overwrite").parquet(f"{self.folder}/{table}/epoch={epoch}")

    def _state(self, table: str, schema: str, epoch: int) -> DataFrame:
        """The latest version of each row of a state table after an epoch."""
        full = epoch - epoch % FULL
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}").filter(F.col("epoch").between(full, epoch))
        values = [c for c in rows.columns if c not in ("id", "epoch")]
        return rows.groupBy("id").agg(F.max_by(F.struct(*values), "epoch").alias("_last")).select("id", "_last.*")

    def stock(self, epoch: int) -> DataFrame:
        """Stock per product after an epoch; -1 is the opening."""
        if epoch < 0:
            return self.products.select("id", F.col("quantity_in_stock").cast("decimal(28,2)").alias("quantity_in_stock"))
        return self._state("stock", _STOCK, epoch)

    def waiting(self, epoch: int) -> DataFrame:
        """Recorded results that wait for an approval after an epoch."""
        if epoch < 0:
            return self.spark.createDataFrame([], "id long, product_id long, quantity_after decimal(18,2)")
        return self._state("waiting", _WAITING, epoch).filter("open").drop("open")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        approvals = "approves" in batch.columns
        if approvals:
            self._with_approvals(batch, epoch)
        else:
            self._movements(batch, epoch)
        if self.levels is not None:
            self._write(low_stock_crossings(self._events(epoch, approvals), self.levels), "alerts", epoch)

    def _movements(self, batch: DataFrame, epoch: int) -> None:
        stock = self.stock(epoch - 1)
        self._write(stock_ledger(stock, batch, self.partitions).journal, "journal", epoch)
        change = F.sum((F.col("quantity_after") - F.col("quantity_before")).cast("decimal(28,2)"))
        moved = self.journal(epoch).filter("accepted and is_approved").groupBy(F.col("product_id").alias("_p")).agg(change.alias("_change"))
        after = stock.join(moved, F.col("id") == F.col("_p"), "left" if epoch % FULL == 0 else "inner")
        self._write(after.select("id", (F.col("quantity_in_stock") + F.coalesce("_change", F.lit(0).cast("decimal(28,2)")))
                                 .cast("decimal(28,2)").alias("quantity_in_stock")), "stock", epoch)

    def _with_approvals(self, batch: DataFrame, epoch: int) -> None:
        copy = shared_folder(self.spark, "batch")
        if not self.plain:
            batch = stored(batch, f"{copy}/events")
        approvals = batch.filter(F.col("movement_type") == APPROVE).select(
            "id", F.col("approves").alias("movement_id"), F.col("movement_date").alias("approved_at"))
        movements = batch.filter(~F.col("movement_type").eqNullSafe(APPROVE)).drop("approves")
        if self.plain:
            movements = stored(movements, f"{copy}/movements")  # these are read more often, by column
        waiting = self.waiting(epoch - 1)
        settled = None
        if epoch > 0:
            asked = approvals.select(F.col("movement_id").alias("id")).distinct().join(waiting.select("id"), "id", "left_anti")
            earlier = self.spark.read.parquet(f"{self.folder}/journal").filter(F.col("epoch") < epoch)
            # written out, so that its shuffles are gone before requests are matched
            settled = stored(earlier.select("id", "product_id", "accepted").join(asked, "id", "left_semi"), f"{copy}/settled")
        stock = self.stock(epoch - 1)
        posted = ledger_with_approvals(stock, movements, approvals, self.partitions, waiting=waiting, settled=settled)
        remove(self.spark, copy)  # what is posted has been written
        self._write(posted.journal, "journal", epoch)
        self._write(posted.approvals, "approvals", epoch)
        journal, decided = self.journal(epoch), self.approvals(epoch).filter("accepted")
        self._write_state(posted, journal, decided, epoch)
        remove(self.spark, posted.copy)

    def _write_state(self, posted: Ledger, journal: DataFrame, decided: DataFrame, epoch: int) -> None:
        if epoch % FULL == 0:
            self._write(posted.products.select("id", F.col("quantity_in_stock").cast("decimal(28,2)").alias("quantity_in_stock")), "stock", epoch)
            self._write(posted.pending.withColumn("open", F.lit(True)), "waiting", epoch)
            return
        moved = journal.filter("accepted and is_approved").select("product_id").unionByName(decided.select("product_id")).distinct()
        changed = posted.products.join(moved, F.col("id") == F.col("product_id"), "left_semi")
        self._write(changed.select("id", F.col("quantity_in_stock").cast("decimal(28,2)").alias("quantity_in_stock")), "stock", epoch)
        recorded = journal.filter("accepted and not coalesce(is_approved, false)").select("id", "product_id", "quantity_after")
        done = decided.select(F.col("movement_id").alias("id"), "product_id", "quantity_after", F.lit(False).alias("open"))
        new = recorded.join(done, "id", "left_anti").withColumn("open", F.lit(True))
        self._write(new.unionByName(done), "waiting", epoch)

    def run(self, events: DataFrame, checkpoint: str) -> None:
        """Process all available input of a stream."""
        self.plain = _is_plain(events)
        query = (events.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    def _read(self, table: str, epoch: int | None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}" + ("" if epoch is None else f"/epoch={epoch}"))

    def journal(self, epoch: int | None = None) -> DataFrame:
        """Posted movements of an epoch, or of all."""
        return self._read("journal", epoch)

    def approvals(self, epoch: int | None = None) -> DataFrame:
        """Decided approvals of an epoch, or of all."""
        return self._read("approvals", epoch)

    def alerts(self) -> DataFrame:
        """Low-stock alerts of all epochs."""
        return self._read("alerts", None)

    def _events(self, epoch: int, approvals: bool) -> DataFrame:
        """What moved the stock in an epoch, movements and approvals alike."""
        columns = ["id", "product_id", "movement_type", "movement_date", "is_approved", "quantity_before", "quantity_after", "accepted"]
        rows = self.journal(epoch).select(*columns)
        if not approvals:
            return rows
        return rows.unionByName(self.approvals(epoch).select(
            "id", "product_id", F.lit(APPROVE).alias("movement_type"), F.col("approved_at").cast(rows.schema["movement_date"].dataType).alias("movement_date"),
            F.lit(True).alias("is_approved"), "quantity_before", "quantity_after", "accepted"))

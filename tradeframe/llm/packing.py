"""Best-fit packing of documents into sequences of a fixed length.

A document's ids end with ``END``. Only a document longer than a sequence is cut, from its end, so
that its first piece alone may be shorter than a sequence.

Best-two-fit decides by lengths only, and there are at most ``LIMIT`` different ones. So it runs
on the count of each length, which is all that reaches the driver: a sequence is filled greedily
with the longest piece that fits; then its shortest piece gives way to two pieces not yet packed,
if they fill its place and the gap more tightly. The sequence so found is repeated while all its
lengths last. Every such step at least halves the count of one of its lengths, so the plan has at
most ``LIMIT`` * log2(pieces) steps, of some 44 different lengths each, whatever the input; in
practice some thousand rows. It says which pieces of a length, by rank, go where.

Ranks need no window over a length: each task numbers its own pieces of each length while it
writes them, and what the tasks before it have is a sum over one row per task and length.

Rows: a null text is empty; an empty text is the single id ``END``. Nulls in ``doc_id`` and repeated
rows pass through, each row packed by itself. Columns other than ``doc_id`` and ``text`` are not
read. An empty table gives no rows. Texts are handled in parts of a few MB; a row is never split.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeframe.llm.common import extended, kept, slices

LIMIT = 1024
END = 2
PLAN = "length int, first long, last long, uses int, base long, at int"


@lru_cache(2)
def encoder(content: bytes, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def lengths(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    first = n % limit or limit
    return [first, *[limit] * ((n - first) // limit)]


def crc(ids: np.ndarray) -> int:
    """The CRC-32 of ids as unsigned little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], limit: int = LIMIT, digest: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (array; with ``digest`` only their ``ids_crc32``) of every
    piece of every document, and ``block`` and ``place``: the task that made it, and its number among the
    task's pieces of its length."""
    with open(ranks, "rb") as file:  # 1 MB whatever the input
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    names = tuple(special.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content.value, pattern, names)
        seen = np.zeros(limit + 1, np.int64)
        task = TaskContext.get().partitionId()
        for part in slices(batches, "text"):
            rows, columns = [], ([], [], [], [], [])
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = np.array([*encode.encode(text or "", allowed_special="all"), END], np.int32)
                start = 0
                for number, length in enumerate(lengths(len(ids), limit)):
                    rows.append(i)
                    own = ids[start : start + length]
                    for column, value in zip(columns, (number, start, length, crc(own) if digest else own, seen[length])):
                        column.append(value)
                    seen[length] += 1
                    start += length
            number, start, length, found, place = columns
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(found, pa.int64() if digest else pa.list_(pa.int32())), pa.array(np.full(len(rows), task, np.int32)),
                pa.array(place, pa.int64())], names=schema.names)

    rows = docs.select("doc_id", "text")
    content_column = "ids_crc32 long" if digest else "ids array<int>"
    schema = extended(rows.select("doc_id").schema, f"piece int, start long, length long, {content_column}, block int, place long")
    return rows.mapInArrow(work, schema)


def filled(left: np.ndarray) -> dict[int, int]:
    """One sequence by best-two-fit from the pieces ``left`` (count by length): length to number of uses."""
    free = left.copy()
    gap = len(free) - 1
    inside: list[int] = []
    while len(fitting := np.flatnonzero(free[: gap + 1])):
        inside.append(int(fitting[-1]))
        free[inside[-1]] -= 1
        gap -= inside[-1]
    while gap:
        shortest = min(inside)
        room = gap + shortest
        one = np.flatnonzero(free[:room])
        if not len(one):
            break
        largest = np.maximum.accumulate(np.where(free[: room + 1] > 0, np.arange(room + 1), 0))
        two = largest[room - one]
        alone = (two == one) & (free[one] < 2)  # the only piece of its length can't be both
        two = np.where(alone, largest[one - 1], two)
        both = np.where(two > 0, one + two, 0)
        best = int(both.argmax())
        if both[best] <= shortest:
            break
        inside.remove(shortest)
        free[shortest] += 1
        for length in (int(one[best]), int(two[best])):
            inside.append(length)
            free[length] -= 1
        gap = room - int(both[best])
    return {length: inside.count(length) for length in sorted(set(inside), reverse=True)}


def plan(counts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """For all pieces (``counts`` by length, up to the sequence's): length, first and last rank (exclusive)
    of its pieces, how many of them each sequence takes, the first sequence, the place in it."""
    left = counts.copy()
    left[0] = 0
    taken = np.zeros_like(left)
    rows, base = [], 0
    while left.any():
        uses = filled(left)
        times = min(int(left[length]) // n for length, n in uses.items())
        at = 0
        for length, n in uses.items():
            rows.append((length, int(taken[length]), int(taken[length]) + times * n, n, base, at))
            taken[length] += times * n
            left[length] -= times * n
            at += length * n
        base += times
    return rows


def packed(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (with ``length``, ``block`` and ``place``) and where each goes: ``sequence_id``, ``offset``.
    ``found`` must give the same rows whenever it is read (a written table)."""
    spark = found.sparkSession
    each = found.groupBy("length", "block").agg(F.count("*").alias("n"))
    # one row per task and length, so the window is over as many rows as there were tasks
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = kept(each.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "packing-counts")
    counts = np.zeros(limit + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[r["length"]] = r["n"]
    steps = F.broadcast(spark.createDataFrame(plan(counts), PLAN).withColumnRenamed("length", "_length"))
    ranked = found.join(before.drop("n"), ["length", "block"]).withColumn("rank", F.col("before") + F.col("place"))
    here = F.col("rank") - F.col("first")
    placed = ranked.join(steps, (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return placed.select(
        *found.columns, (F.col("base") + F.expr("(rank - first) div uses")).alias("sequence_id"),
        (F.col("at") + here % F.col("uses") * F.col("length")).cast("long").alias("offset"))


def sequences(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], limit: int = LIMIT) -> DataFrame:
    """Every piece with its ids and its place: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id``,
    ``offset``. ``ranks`` is a vocabulary file of token and rank, ``pattern`` its way to cut texts."""
    return packed(kept(pieces(docs, ranks, pattern, special, limit), "packing-pieces"), limit).drop("block", "place")


def placements(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], limit: int = LIMIT) -> DataFrame:
    """As ``sequences``, with ``ids_crc32`` in place of the ids, which are never written."""
    found = pieces(docs, ranks, pattern, special, limit, digest=True)
    return packed(kept(found, "packing-places"), limit).drop("block", "place")

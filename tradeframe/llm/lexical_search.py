"""Ranked lexical search by pair-bound MaxScore.

The documents are read once for their terms that any item asks for; from these rows come the
statistics and then, a segment of some thousand documents at a time, an index: the postings of
each term with their impacts (what the term adds to a document's score), each term's maximum
impact, and for pairs of terms that an item asks for together the maximum joint impact over the
intersection of their postings.

A document adds for the pair (a, b) at most the largest of a's maximum, b's maximum and the joint
maximum, which is less than the sum of the two maxima where no document has both at their best.
An item's terms are paired by weight, rare with rare. With these bounds in ascending order, the
units (pairs) that together stay below the tenth best score so far cannot bring up a document by
themselves: only documents with a term of another unit are candidates, and a candidate is dropped
as soon as its score and the bounds of the units left stay below the tenth. A segment whose bounds
all together stay below is skipped. The bounds are exact integers, so the result is exact; each
task hands on at most ten documents per item.

Items are taken in blocks of at most ``MOST_TERMS`` (item, term) rows (an item with more is a block of
its own), each of which is sent to all tasks: a stated query set against all rows, in blocks.

Rows: a null or empty text has no terms; such documents never match and count in no statistic,
such items have no result. Items with the same ``item_id`` (a null one too) are one item with the
terms of all of them. Documents are rows: repeated rows and ids are ranked each; a null ``doc_id``
comes last among equals. Columns other than ``doc_id``, ``item_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeframe.llm.common import kept, slices

BEST = 10
#: (item, term) rows of a block of items.
MOST_TERMS = 500_000
#: Postings of a segment of the index.
SEGMENT = 2_000_000

# Bytes: A-Z to lower case, digits, letters and all beyond ASCII as they are, the others to a blank.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and ``term``, each once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [sorted(set(terms(t))) for t in part.column("text").to_pylist()]
            rows = [i for i, line in enumerate(found) for _ in line]
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(pa.array(rows, pa.int64())), pa.array([t for line in found for t in line], pa.binary())],
                names=["item_id", "term"])

    rows = items.select("item_id", "text")
    schema = T.StructType([rows.schema["item_id"], T.StructField("term", T.BinaryType())])
    return rows.mapInArrow(work, schema).distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """For every document with a term: ``doc_id``, ``n`` (its terms with repeats), and ``terms`` and ``tfs``, the
    numbers of its terms in the vocabulary and how often they occur."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = max(len(vocabulary), 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for part in slices(batches, "text"):
            lines = [terms(t) for t in part.column("text").to_pylist()]
            n = np.fromiter(map(len, lines), np.int64, len(lines))
            found = np.fromiter((get(t, -1) for line in lines for t in line), np.int64, int(n.sum()))
            key = (np.repeat(np.arange(len(lines)), n) * size + found)[found >= 0]
            key, tf = np.unique(key, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(lines) + 1) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array((key % size).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int64)))],
                names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n long, terms array<int>, tfs array<long>").fields])
    return rows.mapInArrow(work, schema)


@dataclass
class Questions:
    """A block of items: their term numbers by weight, and what the scores need."""

    items: list[list[int]]
    weight: np.ndarray
    documents: int
    length: int
    units: list[list[tuple[int, ...]]] = field(init=False)

    def __post_init__(self) -> None:
        ordered = [sorted(line, key=lambda t: (self.weight[t], t)) for line in self.items]
        self.units = [[tuple(line[i : i + 2]) for i in range(0, len(line), 2)] for line in ordered]

    def measure(self, n: np.ndarray) -> np.ndarray:
        """The length measure m of documents with ``n`` terms."""
        if len(n) and 90 * int(n.max()) * self.documents >= 1 << 63:
            return np.array([10 + 90 * int(x) * self.documents // self.length for x in n], np.int64)
        return 10 + 90 * n * self.documents // self.length


class Segment:
    """The index of some documents."""

    def __init__(self, asked: Questions, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        doc = np.repeat(np.arange(len(n)), sizes)
        impact = asked.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * asked.measure(n)[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(term)]
        self.span = dict(zip(term[starts].tolist(), zip(starts.tolist(), ends.tolist())))
        top = np.maximum.reduceat(self.impact, starts) if len(starts) else starts
        self.top = dict(zip(term[starts].tolist(), top.tolist()))
        self.scratch = np.zeros(len(n), np.int64)
        self.joint = {unit: self.bound(unit) for unit in {u for line in asked.units for u in line}}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.span.get(term, (0, 0))
        return self.doc[a:b], self.impact[a:b]

    def bound(self, unit: tuple[int, ...]) -> int:
        """The most that a document gets from a pair of terms, or a single one."""
        most = max(self.top.get(t, 0) for t in unit)
        if len(unit) == 2 and all(t in self.span for t in unit):
            docs, impact = self.of(unit[0])
            self.scratch[docs] = impact
            others, more = self.of(unit[1])
            both = self.scratch[others]
            if (hit := both > 0).any():
                most = max(most, int((both[hit] + more[hit]).max()))
            self.scratch[docs] = 0
        return most

    def best(self, units: list[tuple[int, ...]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score ``least`` or more, at the least all of the ``BEST`` best of them, and their scores."""
        ordered = sorted(units, key=lambda u: self.joint[u])
        sums = np.cumsum([self.joint[u] for u in ordered], dtype=np.int64)
        aside = int(np.searchsorted(sums, least))  # units that together stay below
        none = np.zeros(0, np.int64)
        if aside == len(ordered):
            return none, none
        score = self.scratch
        for unit in ordered[aside:]:
            for term in unit:
                docs, impact = self.of(term)
                score[docs] += impact
        found = np.flatnonzero(score)
        got = score[found]
        score[found] = 0
        for i in range(aside, -1, -1):
            if len(got) > BEST:  # what is reached already may raise the bar
                least = max(least, int(np.partition(got, -BEST)[-BEST]))
            stays = got + (sums[i - 1] if i else 0) >= least
            found, got = found[stays], got[stays]
            for term in ordered[i - 1] if i else ():
                docs, impact = self.of(term)
                if len(docs):
                    at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    got = got + np.where(docs[at] == found, impact[at], 0)
        return found, got


def candidates(rows: DataFrame, asked: Questions) -> DataFrame:
    """``item`` (its number in the block), ``doc_id``, ``score``: from each task the best of each item."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in asked.items]
        for group in segments(batches):
            ids, n, sizes, term, tf = group
            segment = Segment(asked, n, sizes, term, tf)
            missing = np.array([i is None for i in ids])
            number = np.array([0 if i is None else i for i in ids], np.int64)
            for units, held in zip(asked.units, best):
                found, score = segment.best(units, -held[-1][0] if len(held) == BEST else 1)
                order = np.lexsort((number[found], missing[found], -score))[:BEST]
                if len(order):
                    held += zip((-score[order]).tolist(), missing[found[order]].tolist(), number[found[order]].tolist())
                    held.sort()
                    del held[BEST:]
        flat = [(item, None if empty else doc_id, -score) for item, held in enumerate(best) for score, empty, doc_id in held]
        yield pa.RecordBatch.from_pylist([dict(zip(("item", "doc_id", "score"), row)) for row in flat],
                                         schema=pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return rows.mapInArrow(work, "item int, doc_id long, score long")


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of ``postings`` together: ids, terms with repeats, postings of each document, their terms, their counts."""
    held: list[pa.RecordBatch] = []
    total = 0

    def together() -> tuple:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
        sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return (table.column("doc_id").to_pylist(), table.column("n").to_numpy(), sizes,
                lists[0].flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists[1].flatten().to_numpy(zero_copy_only=False))

    for batch in batches:
        held.append(batch)
        total += len(batch.column("terms").flatten())
        if total >= SEGMENT:
            yield together()
            held, total = [], 0
    if held:
        yield together()


def in_blocks(wanted: DataFrame, most: int) -> list[list[Row]]:
    """The items, as rows of ``item_id`` and ``terms``, a block at a time (each block is one collect)."""
    parts = -(-wanted.count() // most)
    deal = F.pmod(F.xxhash64("item_id"), F.lit(max(parts, 1)))
    for part in range(parts):
        yield wanted.filter(deal == part).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()


def search(docs: DataFrame, items: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ten best documents of each item."""
    spark = docs.sparkSession
    wanted = kept(item_terms(items), "search-items")
    out = None
    name = items.schema["item_id"]
    for rows in in_blocks(wanted, most):
        if not rows:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        found = kept(postings(docs, vocabulary), "search-postings")
        size = found.agg(F.count("*"), F.sum("n")).first()
        frequency = np.zeros(len(vocabulary), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
            frequency[r["term"]] = r["df"]  # a row per term of the block
        n = size[0]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
        asked = Questions([[vocabulary[bytes(t)] for t in r["terms"]] for r in rows], weight, n, size[1] or 1)
        numbers = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), name]))
        best = candidates(found, asked).join(F.broadcast(numbers), "item")  # a row per item of the block
        out = best if out is None else out.unionByName(best)
    if out is None:
        empty = T.StructType([name, *T.StructType.fromDDL("doc_id long, score long, item int").fields])
        out = spark.createDataFrame([], empty)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST).select("item_id", "rank", "doc_id", "score")

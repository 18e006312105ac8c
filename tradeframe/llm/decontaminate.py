"""Benchmark passages in documents, by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words; an item of fewer words is
one window. A document that contains a window contains its rarest word. So the words of the
benchmark are ordered by how often the documents have them, each window is looked up by the one
word of it that comes first in this order (the prefix that full containment needs), and only
documents' occurrences of such words travel. Each carries the words around it. A pair must pass
the length bound (the document is as long as the window) and the positional bound (the word has
as many words before and after it as in the window); then the words are compared exactly.

The documents are read twice: to count the words of the benchmark, and for the occurrences. In
both, tasks drop words that can't matter by a bitmap of hashes of fixed size (``BITS``), whatever
the benchmark's size; a false hit is dropped by the join.

Rows: null texts have no words; documents without words and tables without rows give zeros and
false. An item without words has no window. A null ``item_id`` is not counted or listed, but its
windows hit. Rows that repeat a ``doc_id`` are judged by their own text; a null ``doc_id`` is a value
like any other. Only ``doc_id``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.common import extended, folded, kept, slices, unfolded

WINDOW = 10
#: Size of the bitmap of word hashes: 2 MB.
BITS = 1 << 24

#: Lower case for A-Z; every other ASCII character but digits and a-z separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id``, ``window`` (its words joined by a space), ``n`` (their number); distinct."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            found = []
            for i, text in enumerate(part.column("text").to_pylist()):
                line = words(text)
                for a in range(max(len(line) - size, 0) + 1 if line else 0):
                    window = line[a : a + size]
                    found.append((i, b" ".join(window).decode(), len(window)))
            rows, texts, sizes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())],
                names=["item_id", "window", "n"])

    rows = items.select("item_id", "text")
    return rows.mapInArrow(work, extended(rows.select("item_id").schema, "window string, n int")).distinct()


def bitmap(frame: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashes of a column's values: at most ``BITS``, built in parts by the tasks."""
    number = (F.crc32(F.col(column).cast("binary")) % BITS + 1).cast("long")  # these functions count from 1
    parts = frame.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")).collect()
    bits = np.zeros(BITS, bool)
    for r in parts:  # 512 of 4 KB at most
        one = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        at = (r["bucket"] - 1) * 32768
        bits[at : at + 32768] |= one.astype(bool)
    return np.packbits(bits)


#: Words whose answer a task remembers, and bytes of text that it looks at together.
REMEMBERED, SLICE = 100_000, 1_000_000


class Lookup:
    """Is a word's hash in the bitmap? Answers are remembered for a while."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits.tobytes()
        self.known: dict[bytes, bool] = {}

    def among(self, found: set[bytes]) -> set[bytes]:
        known, bits = self.known, self.bits
        if len(known) > REMEMBERED:
            known.clear()
        some = set()
        for w in found:
            if (member := known.get(w)) is None:
                at = zlib.crc32(w) % BITS
                member = known[w] = bool(bits[at >> 3] << (at & 7) & 128)
            if member:
                some.add(w)
        return some


def word_counts(docs: DataFrame, bits) -> DataFrame:
    """``word`` and ``n``: how often the documents have the words whose hash is in the bitmap."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(bits.value)
        for part in slices(batches, "text", SLICE):
            counts: Counter[bytes] = Counter()
            for text in part.column("text").to_pylist():
                counts.update(words(text))
            some = sorted(lookup.among(set(counts)))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in some], pa.string()), pa.array([counts[w] for w in some], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, bits, size: int = WINDOW) -> DataFrame:
    """A row per document, with its words' number, a hash of its text, and ``places``: where it has
    a word of the bitmap, with up to ``size`` - 1 words on either side (``before`` says how many
    are in front)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(bits.value)
        for part in slices(batches, "text", SLICE):
            lengths, places = [], []
            for text in part.column("text").to_pylist():
                line = words(text)
                lengths.append(len(line))
                some = lookup.among(set(line))
                found = []
                if some:
                    for i, w in enumerate(line):
                        if w in some:
                            a = max(0, i - size + 1)
                            found.append({"word": w.decode(), "at": i, "before": i - a, "around": b" ".join(line[a : i + size]).decode()})
                places.append(found)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array(lengths, pa.int64()), pa.array(places, kind)], names=["doc_id", "mark", "n_words", "places"])

    kind = pa.list_(pa.struct([("word", pa.string()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    schema = extended(
        rows.select("doc_id", "mark").schema, "n_words long, places array<struct<word:string,at:int,before:int,around:string>>")
    return rows.mapInArrow(work, schema)


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """All documents (``doc_id``, ``mark``, ``n_words``), and every occurrence of a window in them
    (``doc_id``, ``mark``, ``item_id``, ``start``, ``n``)."""
    context = docs.sparkSession.sparkContext
    asked = kept(windows(items, size), "benchmark-windows")
    members = asked.select("item_id", "window", "n", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    counts = word_counts(docs, context.broadcast(bitmap(members, "word")))
    # the rarest word of each window; ties by the word, then its place
    rarity = F.struct(F.coalesce("total", F.lit(0)).alias("total"), "word", "offset")
    first = kept(members.join(counts.withColumnRenamed("n", "total"), "word", "left")
                 .groupBy("window", "n").agg(F.min(rarity).alias("rare"), F.collect_set("item_id").alias("item_ids"))
                 .filter(F.col("rare.total") > 0)
                 .select(F.col("rare.word").alias("word"), F.col("rare.offset").alias("offset"), "window", "n", "item_ids"), "benchmark-prefixes")
    found = kept(occurrences(docs, context.broadcast(bitmap(first, "word")), size), "benchmark-places")
    places = found.select("doc_id", "mark", "n_words", F.explode("places").alias("p")).select("doc_id", "mark", "n_words", "p.*")
    pairs = places.join(first, "word").filter((F.col("n_words") >= F.col("n")) & (F.col("before") >= F.col("offset")))
    around = F.split("around", " ")
    same = F.array_join(F.slice(around, F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("window")
    matched = pairs.filter(same).select("doc_id", "mark", "item_ids", (F.col("at") - F.col("offset")).alias("start"), "n")
    return found.select("doc_id", "mark", "n_words"), matched


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id``, ``mark``, ``n_words``, ``n_hit`` (words inside some window), ``item_ids`` (sorted) per document."""
    every, matched = hits(docs, items, size)
    # windows of one place are merged before positions are spread out
    spans = matched.groupBy("doc_id", "mark", "start").agg(F.max("n").alias("n"), F.flatten(F.collect_set("item_ids")).alias("item_ids"))
    # words hit: each start counts up to the next one
    ordered = F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))))
    per_doc = spans.groupBy("doc_id", "mark").agg(ordered.alias("spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    swept = F.aggregate("spans", state, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["upto"], x["start"]))).cast("long").alias("n"), F.greatest(s["upto"], x["stop"]).alias("upto")))
    per_doc = per_doc.select("doc_id", "mark", swept["n"].alias("n_hit"), "item_ids")
    # repeated rows have the same spans, once
    same = [every[c].eqNullSafe(per_doc[c]) for c in ("doc_id", "mark")]
    return every.join(per_doc, same, "left").select(
        every["doc_id"], every["mark"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.array_sort(F.transform(F.coalesce("item_ids", F.array()), lambda x: x.cast("string"))).alias("item_ids"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any window of the benchmark, all columns."""
    _, matched = hits(docs, items)
    bad = matched.select("doc_id", "mark").distinct()
    rows = folded(docs).withColumn("mark", F.xxhash64("text"))
    same = [rows[c].eqNullSafe(bad[c]) for c in ("doc_id", "mark")]
    return unfolded(rows.join(bad, same, "left_anti"), docs.columns)

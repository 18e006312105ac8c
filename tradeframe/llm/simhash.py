"""Near copies by SimHash, found with anchor points.

A fingerprint has 64 bits; two link if at most three differ. Then one of the two halves differs
in at most one bit. The anchors of a half are the code words of the perfect Hamming code over 31
of its bits: every value is within distance 1 (the covering radius) of exactly one anchor, its
home. Every half goes to each anchor within radius plus threshold, 1 + 1; two halves that differ
in at most one bit then meet at the home of either. Each anchor compares what it has.

Equal fingerprints are one: copies are counted, not compared. An anchor passes on no pairs but
the edges that join its members' components, one fewer than members. To find them it starts at a
fingerprint and takes everything within three bits out of the rest, then goes on from those; a
dense group of near copies is used up after a few comparisons with all of it.

Rows: a null text is empty; a text without words has fingerprint zero and links like any other.
A null ``doc_id`` has a fingerprint and is linked, but names no component (a component of such
rows alone has a null id). Repeated rows pass through, one result per row. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tradeframe.llm.common import extended, folded, kept, met, part_count, slices, unfolded
from tradeframe.llm.components import components

SHINGLE = 3
MOST_BITS = 3
SEED = 42
#: Bits of a half that the code covers: 31 = 2**5 - 1.
COVERED = 31
#: Rows that a bucket of anchors holds about, at two halves of up to 17 anchors per fingerprint.
PER_BUCKET = 400_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text, as uint64."""
    hashes: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode().translate(LOWER).split()
        if not words:
            continue
        n = max(len(words) - size + 1, 1)
        if n == 1:
            hashes.append(xxh64_intdigest(b" ".join(words), SEED))
        else:
            line = b" ".join(words)
            ends, at = [], -1
            for w in words:
                at += len(w) + 1
                ends.append(at)
            starts = [0, *(e + 1 for e in ends[:-1])]
            hashes += [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]
        lengths[i] = n
    result = np.zeros(len(texts), np.uint64)
    filled = np.flatnonzero(lengths)
    if not len(filled):
        return result
    stops = np.cumsum(lengths[filled])
    first = stops - lengths[filled]
    every = np.array(hashes, np.uint64)
    counts = np.zeros((len(filled), 64), np.int64)
    # a few documents at a time, so that 64 bytes per shingle stay a small table
    a = 0
    while a < len(filled):
        b = max(a + 1, int(np.searchsorted(stops, first[a] + 200_000)))
        b = min(b, len(filled))
        bits = np.unpackbits(every[first[a] : stops[b - 1]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts[a:b] = np.add.reduceat(bits, first[a:b] - first[a], axis=0, dtype=np.int64)
        a = b
    over = counts * 2 > lengths[filled][:, None]
    result[filled] = np.packbits(over, axis=1).view(">u8").ravel()
    return result


def with_fingerprint(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and ``fp`` (64 bits as a signed long)."""
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = fingerprints(part.column("text").to_pylist(), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found)], names=[*keep, "fp"])

    return rows.mapInArrow(work, extended(rows.select(*keep).schema, "fp long"))


@lru_cache(1)
def flips() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 32 syndromes: what turns a value into its home, and into the other anchors
    at distance 2 (15 of them, or the home again). Bit i has the check value i + 1."""
    bit = [0] + [1 << (i - 1) for i in range(1, COVERED + 1)]
    home = np.array(bit, np.uint64)
    others = np.zeros((32, 15), np.uint64)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        others[s] = [bit[i] ^ bit[j] for i, j in pairs]
    return home, others


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homes of 31-bit values, and their other anchors within distance 2 (a row each)."""
    syndrome = np.zeros(len(values), np.int64)
    for i in range(COVERED):
        syndrome ^= np.where(values >> np.uint64(i) & np.uint64(1), i + 1, 0)
    home, others = flips()
    return values ^ home[syndrome], values[:, None] ^ others[syndrome]


def placed(prints: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``anchor`` (code word with the half in bit 31), ``fp`` and ``home`` (is it the
    fingerprint's home?) for every anchor of every fingerprint."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            for half in (0, 1):
                value = bits >> np.uint64(32 * half) & np.uint64((1 << COVERED) - 1)
                near, far = anchors(value)
                everywhere = np.concatenate([near[:, None], far], axis=1)
                # a code word has no other anchor within distance 2: its home once
                first = np.concatenate([np.ones((len(fp), 1), bool), far != near[:, None]], axis=1)
                first[:, 1:] &= (value != near)[:, None]
                row, column = np.nonzero(first)
                anchor = everywhere[row, column].astype(np.int64) | half << COVERED
                mixed = (anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((mixed % np.uint64(buckets)).astype(np.int32)), pa.array(anchor), pa.array(fp[row]), pa.array(column == 0)],
                    names=["bucket", "anchor", "fp", "home"])

    return prints.select("fp").mapInArrow(work, "bucket int, anchor long, fp long, home boolean")


def joined(members: np.ndarray, most: int = MOST_BITS) -> Iterator[tuple[int, int]]:
    """Edges that join the components of ``members`` under the bit distance."""
    rest = members
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = np.bitwise_count(rest ^ one) <= most
            if near.any():
                found = rest[near]
                for other in found:
                    yield int(one), int(other)
                front.extend(found)
                rest = rest[~near]


def linked(bucket: pa.Table) -> pa.Table:
    """Edges of all anchors of one bucket."""
    anchor = bucket.column("anchor").to_numpy()
    order = np.argsort(anchor, kind="stable")
    anchor = anchor[order]
    fp = bucket.column("fp").to_numpy()[order].view(np.uint64)
    home = bucket.column("home").to_numpy()[order]
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(anchor)])
    homes = np.add.reduceat(home, starts, dtype=np.int64) if len(starts) else sizes
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    two = starts[(sizes == 2) & (homes > 0)]
    close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= MOST_BITS
    a.append(fp[two[close]])
    b.append(fp[two[close] + 1])
    for start, size in zip(starts[(sizes > 2) & (homes > 0)], sizes[(sizes > 2) & (homes > 0)]):
        if edges := list(joined(fp[start : start + size])):
            x, y = zip(*edges)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
    return pa.table({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def near_groups(prints: DataFrame) -> DataFrame:
    """``fp`` and ``root`` for every fingerprint that links to a different one."""
    n = prints.count()
    buckets = max(part_count(prints.sparkSession), n * 33 // PER_BUCKET + 1)
    edges = placed(prints, buckets).groupBy("bucket").applyInArrow(linked, "a long, b long")
    return components(edges).select(F.col("node").alias("fp"), "root")


def hex_of(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def rooted(docs: DataFrame, keep: tuple[str, ...], size: int = SHINGLE) -> DataFrame:
    """The columns ``keep``, ``fp``, ``root`` (a fingerprint that names the group) and ``component_id``."""
    rows = kept(with_fingerprint(docs, keep, size), "simhash-rows")
    prints = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-prints")
    roots = prints.join(near_groups(prints), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = roots.join(least, "root").select("fp", "root", "component_id")
    # a third of all rows may share one fingerprint
    return met(rows, prints, of_print, "fp", F.xxhash64("doc_id"), "inner").select(*keep, "fp", "root", "component_id")


def grouped(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """The columns ``keep``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest
    ``doc_id`` that links reach) of every document."""
    return rooted(docs, keep, size).select(*keep, hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns: of each group the row with the smallest ``doc_id``, then
    fingerprint and hash of the text (one row of those that repeat all of it). Groups may have the
    same smallest ``doc_id``; each keeps its row. A group of rows without ``doc_id`` keeps one row
    per fingerprint."""
    rows = folded(docs).withColumn("hash", F.xxhash64("text"))
    found = kept(rooted(rows, ("doc_id", "hash")), "simhash-groups")
    first = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min(F.struct("doc_id", "fp", "hash")).alias("first"))
    # a group has all texts of its fingerprint: (doc_id, hash) is of one group
    named = rows.join(first.select("first.doc_id", "first.hash"), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"])
    nameless = found.filter(F.col("doc_id").isNull() & F.col("component_id").isNull()).select("fp").distinct()
    others = with_fingerprint(rows.filter(F.col("doc_id").isNull()), tuple(rows.columns))
    others = others.join(nameless, "fp", "left_semi").dropDuplicates(["fp"])
    return unfolded(named.unionByName(others.select(*named.columns)), docs.columns)

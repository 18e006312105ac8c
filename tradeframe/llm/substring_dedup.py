"""Repeated word windows across documents, by super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash among its runs of
``MINIMISER`` words. Consecutive windows with the same minimiser are packed in one string, which
holds their words once (a super-k-mer), and equal windows have equal minimisers wherever they
stand. So a string goes to the bucket of its minimiser, where it is unpacked, windows are sorted
and compared word for word, and the earliest place of each is known.

1. Blocks of documents send each minimiser once, with the number of places it has as the first
   least hash of a window. Equal windows have it at equal distance from their start, so one with
   a single place in the corpus can't hide a repeated window; its strings stay at home.
2. Blocks send the strings of the other minimisers, each different string once with its earliest
   place. Copies thus travel once per block. A minimiser with more than ``HOT`` strings (a passage
   that very many documents share, each with other words around it) would fill one bucket: its
   windows are sent one by one instead and counted by their own text.
3. Buckets answer each string with the earliest places of its repeated windows, as ranges; blocks
   remove the words of every window that has an earlier one.

Steps 1 and 2 read one shuffle of the documents to their blocks; the strings are written, and
step 3 deals the documents out again.

Rows: a null text has no words. A document is its ``doc_id``: rows that repeat one do not make each
other's windows repeated at the same place, and a null ``doc_id`` comes before all others. Ties
(same ``doc_id``, same start) keep both. Other columns named in ``keep`` pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeframe.llm.blocks import in_blocks
from tradeframe.llm.common import extended, kept, part_count

WINDOW = 20
MINIMISER = 6
#: Windows in one string at most; longer runs (a word repeated over and over) are cut.
LONGEST = 64
HOT = 5_000
#: Characters of a block of documents, and strings of a bucket, about.
BLOCK = 2_000_000
PER_BUCKET = 40_000
NO_ID = np.iinfo(np.int64).min

FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(FACTOR, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``FACTOR`` and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK * 5 // 4)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, f, np.uint64)], dtype=np.uint64) for f in (FACTOR, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of some texts, as arrays. ``line`` has every word followed by one space; word i
    is ``line[start[i]:stop[i]]`` and belongs to text ``text[i]``, whose first word is
    ``first[text[i]]``."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        inside = ~blank
        begins = inside.copy()
        begins[1:] &= blank[:-1]
        ends = np.zeros(len(raw), bool)
        ends[1:] = blank[1:] & inside[:-1]
        at, to = np.flatnonzero(begins), np.flatnonzero(ends)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, np.r_[0, np.cumsum(lengths)])))
        self.count = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.line = np.where(blank, np.uint8(32), raw)[inside | ends]
        size = to - at
        self.start = np.cumsum(size + 1) - (size + 1)
        self.stop = self.start + size
        up, down = powers(len(self.line) + 1)
        total = np.r_[np.uint64(0), np.cumsum((self.line.astype(np.uint64) + np.uint64(1)) * up[: len(self.line)], dtype=np.uint64)]
        self.hash = mixed((total[self.stop] - total[self.start]) * down[self.start])

    def bytes(self) -> bytes:
        return self.line.tobytes()

    def runs(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each word on, across texts."""
        count = max(len(self.hash) - n + 1, 0)
        x = np.zeros(count, np.uint64)
        for i in range(n):
            x = x * np.uint64(FACTOR) + self.hash[i : i + count]
        return mixed(x)

    def windows(self, n: int) -> np.ndarray:
        """Words at which a window of ``n`` words begins within one text."""
        count = max(len(self.text) - n + 1, 0)
        return np.flatnonzero(self.text[:count] == self.text[n - 1 : n - 1 + count])


def least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum over ``n`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = n - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def packed(words: Words, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: first window, number of windows, minimiser (signed)."""
    starts = words.windows(size)
    if not len(starts):
        return starts, starts, starts
    lowest = least(words.runs(MINIMISER), size - MINIMISER + 1)[starts]
    new = np.r_[True, (starts[1:] != starts[:-1] + 1) | (lowest[1:] != lowest[:-1]) | (words.text[starts[1:]] != words.text[starts[:-1]])]
    at = np.flatnonzero(new)
    within = np.arange(len(starts)) - np.repeat(at, np.diff(np.r_[at, len(starts)]))
    at = np.flatnonzero(within % LONGEST == 0)
    return starts[at], np.diff(np.r_[at, len(starts)]), lowest[at].view(np.int64)


def texts_of(table: pa.Table) -> list[bytes]:
    return [(t or "").encode() for t in table.column("text").to_pylist()]


def ids_of(table: pa.Table) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)


def places(words: Words, size: int = WINDOW) -> np.ndarray:
    """The minimiser of each place that is the first least hash of some window."""
    starts = words.windows(size)
    if not len(starts):
        return np.zeros(0, np.int64)
    value, span = words.runs(MINIMISER), size - MINIMISER + 1
    lowest = least(value, span)[starts]
    at = np.full(len(starts), -1, np.int64)
    for i in range(span - 1, -1, -1):
        at[value[starts + i] == lowest] = i
    at += starts
    return lowest[np.r_[True, at[1:] != at[:-1]]].view(np.int64)


def asked(table: pa.Table) -> pa.Table:
    """A block's minimisers with the number of their places."""
    keys, n = np.unique(places(Words(texts_of(table))), return_counts=True)
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(keys), block, np.int32)), "key": pa.array(keys.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def pieces_of(words: Words, wanted: np.ndarray, hot: np.ndarray):
    """The strings to look at: minimiser, is it hot, string, first window. A hot minimiser has a
    string for every window."""
    first, n, key = packed(words)
    line, start, stop = words.bytes(), words.start, words.stop
    for chosen, single in ((np.isin(key, wanted), False), (np.isin(key, hot), True)):
        for i in np.flatnonzero(chosen):
            a, k = int(first[i]), int(n[i])
            if single:
                for j in range(a, a + k):
                    yield int(key[i]), True, line[start[j] : stop[j + WINDOW - 1]], j
            else:
                yield int(key[i]), False, line[start[a] : stop[a + k + WINDOW - 2]], a


def sent(docs: pa.Table, keys: pa.Table) -> pa.Table:
    """A block's different strings, with their earliest place and whether there are more."""
    found: dict[bytes, list] = {}
    if len(docs) and len(keys):
        hot = keys.column("hot").to_numpy().astype(bool)
        key = keys.column("key").to_numpy()
        words, ids = Words(texts_of(docs)), ids_of(docs)
        for k, single, string, a in pieces_of(words, key[~hot], key[hot]):
            text = words.text[a]
            place = (int(ids[text]), int(a - words.first[text]))
            if (known := found.get(string)) is None:
                found[string] = [k, single, place, False]
            else:
                known[3] = True
                if place < known[2]:
                    known[2] = place
    block = docs.column("block")[0].as_py() if len(docs) else 0
    rows = found.values()
    return pa.table({
        "block": pa.array(np.full(len(found), block, np.int32)), "key": pa.array([r[0] for r in rows], pa.int64()), "hot": pa.array([r[1] for r in rows], pa.bool_()),
        "string": pa.array(found.keys(), pa.binary()), "doc": pa.array([r[2][0] for r in rows], pa.int64()), "start": pa.array([r[2][1] for r in rows], pa.int32()),
        "more": pa.array([r[3] for r in rows], pa.bool_())})


ANSWER = "block int, key long, hot boolean, digest binary, j int, n int, first_doc long, first_start int"


def settled(bucket: pa.Table) -> pa.Table:
    """Earliest places of the repeated windows in a bucket's strings."""
    strings = bucket.column("string").to_pylist()
    words = Words(strings)
    window = words.windows(WINDOW)
    row = words.text[window]
    j = (window - words.first[row]).astype(np.int64)
    doc, start = bucket.column("doc").to_numpy()[row], bucket.column("start").to_numpy()[row].astype(np.int64) + j
    more = bucket.column("more").to_numpy(zero_copy_only=False).astype(bool)[row]
    value = words.runs(WINDOW)[window]
    order = np.lexsort((start, doc, value))
    value = value[order]
    new = np.r_[True, value[1:] != value[:-1]] if len(value) else np.zeros(0, bool)
    # windows with the same hash have the same words, or are told apart
    line, a, b = words.bytes(), words.start[window[order]], words.stop[window[order] + WINDOW - 1]
    same = np.flatnonzero(~new)
    differ = [i for i in same.tolist() if line[a[i] : b[i]] != line[a[i - 1] : b[i - 1]]]
    if differ:  # sort the hashes concerned by the words themselves
        text = np.array([line[x:y] if v else b"" for x, y, v in zip(a, b, np.isin(value, value[differ]))], dtype=object)
        again = sorted(range(len(order)), key=lambda i: (int(value[i]), text[i], int(doc[order[i]]), int(start[order[i]])))
        order, value, text = order[again], value[again], text[again]
        new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])]
    group = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)][group] if len(order) else order
    repeated = (np.bincount(group)[group] > 1) | more[order] if len(order) else np.zeros(0, bool)
    keep = order[repeated]
    first_doc, first_start = doc[lead[repeated]], start[lead[repeated]]
    back = np.lexsort((j[keep], row[keep]))
    keep, first_doc, first_start = keep[back], first_doc[back], first_start[back]
    r, at = row[keep], j[keep]
    cut = np.r_[True, (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1) | (first_doc[1:] != first_doc[:-1]) | (first_start[1:] != first_start[:-1] + 1)] if len(r) else np.zeros(0, bool)
    begin = np.flatnonzero(cut)
    take = pa.array(r[begin])
    return pa.table({
        "block": bucket.column("block").take(take), "key": bucket.column("key").take(take), "hot": pa.array(np.zeros(len(begin), bool)),
        "digest": pa.array([digest(strings[i]) for i in r[begin]], pa.binary()), "j": pa.array(at[begin].astype(np.int32)),
        "n": pa.array(np.diff(np.r_[begin, len(r)]).astype(np.int32)), "first_doc": pa.array(first_doc[begin]), "first_start": pa.array(first_start[begin].astype(np.int32))})


def digest(string: bytes) -> bytes:
    return hashlib.md5(string, usedforsecurity=False).digest()


def removed(words: Words, ids: np.ndarray, answers: pa.Table) -> np.ndarray:
    """For each word: is it covered by a window that occurs earlier?"""
    covered = np.zeros(len(words.text) + 1, np.int64)
    if len(answers):
        hot = answers.column("hot").to_numpy(zero_copy_only=False).astype(bool)
        key = answers.column("key").to_numpy()
        known: dict[bytes, list[tuple[int, int, int, int]]] = {}
        for d, *run in zip(*(answers.column(c).to_pylist() for c in ("digest", "j", "n", "first_doc", "first_start"))):
            known.setdefault(d, []).append(tuple(run))
        for _, _, string, a in pieces_of(words, np.unique(key[~hot]), np.unique(key[hot])):
            for j, n, first_doc, first_start in known.get(digest(string), ()):
                text = words.text[a]
                if (first_doc, first_start) < (int(ids[text]), int(a - words.first[text]) + j):
                    covered[a + j] += 1
                    covered[a + j + n - 1 + WINDOW] -= 1
    return np.cumsum(covered[:-1]) > 0


def deduplicated(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """The columns ``keep`` of every document, ``n_words``, ``n_removed`` and ``kept`` (the words that
    stay, joined by a space)."""
    columns = dict.fromkeys(["doc_id", "text", *keep])
    dealt = in_blocks(docs.select(*columns), block)
    groups = dealt.groupBy("block")
    minimisers = groups.applyInArrow(asked, "block int, key long, n long")
    # a minimiser has a row per block at most
    total = F.sum("n").over(Window.partitionBy("key"))
    wanted = minimisers.withColumn("total", total).filter("total > 1").select("block", "key", (F.col("total") > hot).alias("hot"))
    strings = kept(groups.cogroup(wanted.groupBy("block")).applyInArrow(
        sent, "block int, key long, hot boolean, string binary, doc long, start int, more boolean"), "repeated-strings")
    buckets = max(part_count(docs.sparkSession) * 4, strings.count() // PER_BUCKET)
    cold = strings.filter("not hot").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(settled, ANSWER)
    single = strings.filter("hot")
    place = F.struct("doc", "start")
    first = single.groupBy("string").agg(F.min(place).alias("first"), (F.bool_or("more") | (F.count("*") > 1)).alias("repeated")).filter("repeated")
    warm = single.join(first, "string").select(
        "block", "key", F.lit(True).alias("hot"), F.unhex(F.md5("string")).alias("digest"), F.lit(0).alias("j"), F.lit(1).alias("n"),
        F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start"))
    answers = cold.unionByName(warm)
    schema = extended(docs.select(*keep).schema, "n_words long, n_removed long, kept string")

    def applied(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, ids = Words(texts_of(docs)), ids_of(docs)
        gone = removed(words, ids, answers)
        n_removed = np.bincount(words.text[gone], minlength=len(docs)).astype(np.int64)
        # every word stands with the space after it
        line = words.line[np.repeat(~gone, words.stop - words.start + 1)].tobytes()
        sizes = np.bincount(words.text[~gone], weights=(words.stop - words.start + 1)[~gone], minlength=len(docs)).astype(np.int64)
        to = np.cumsum(sizes)
        texts = [line[b - s : max(b - 1, 0)].decode() if s else "" for s, b in zip(sizes.tolist(), to.tolist())]
        return pa.table([*(docs.column(c) for c in keep), pa.array(words.count), pa.array(n_removed), pa.array(texts, pa.string())], names=schema.names)

    return groups.cogroup(answers.groupBy("block")).applyInArrow(applied, schema)

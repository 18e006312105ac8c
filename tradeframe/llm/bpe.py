"""Byte-pair encoding and decoding with a public vocabulary.

A text is cut at special strings and into pieces (``pieces.py``). A piece is a row of parts,
one byte each at first, with the rank of every adjacent pair in an array beside it. The
smallest rank is looked up again and again; its boundary is deleted and the two ranks next to
it are refreshed. That scan is quadratic, so pieces longer than ``SHORT`` bytes take the same
merges in the same order from a heap.

Rows: a null text is empty; an empty text has no ids. Nulls in ``doc_id`` and repeated rows pass
through, one result per row; columns other than ``doc_id`` and ``text`` are not read. Texts are
handled in parts of a few MB per task; a row is never split.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from tradeframe.llm import pieces
from tradeframe.llm.common import Recent, extended, slices

SHORT = 256
NO_RANK = 1 << 60
#: Pieces whose ids a worker remembers.
REMEMBERED = 250_000


def alphabet() -> dict[str, int]:
    """The vocabulary file's character for each byte: printable ones stand for themselves,
    the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, content: bytes) -> None:
        file = json.loads(content)
        byte_of = alphabet()
        ids = file["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.of_byte = [0] * 256
        for i, token in self.bytes_of.items():
            if len(token) == 1:
                self.of_byte[token[0]] = i
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(file["model"]["merges"]):
            self.rank[ids[a], ids[b]] = rank
            self.merged.append(ids[a + b])

    def encode(self, piece: bytes) -> list[int]:
        parts = [self.of_byte[b] for b in piece]
        return self.scanned(parts) if len(parts) <= SHORT else self.heaped(parts)

    def scanned(self, parts: list[int]) -> list[int]:
        get, merged = self.rank.get, self.merged
        ranks = [get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NO_RANK:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]  # the boundary between the two parts
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NO_RANK)
        return parts

    def heaped(self, parts: list[int]) -> list[int]:
        get, n = self.rank.get, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = right[i]
            if parts[i] < 0 or j >= n or get((parts[i], parts[j])) != rank:
                continue  # one of the two is gone or has grown
            parts[i], parts[j] = self.merged[rank], -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := get((parts[a], parts[b]))) is not None:
                    heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def load(path: str) -> bytes:
    """The vocabulary file, read by the driver (1.5 MB whatever the input)."""
    with open(path, "rb") as file:
        return file.read()


def segments(texts: list[str | None], special: dict[str, int]) -> tuple[str, list[int]]:
    """All texts in one string, with ``BETWEEN`` after each text and in place of each special
    string; for each ``BETWEEN`` its special id, or -1 at the end of a text."""
    out, marks = [], []
    for text in texts:
        rest = text or ""
        if any(s in rest for s in special):
            while found := [(at, -len(s), s) for s in special if (at := rest.find(s)) >= 0]:
                at, _, s = min(found)
                out += [rest[:at], pieces.BETWEEN]
                marks.append(special[s])
                rest = rest[at + len(s) :]
        out += [rest, pieces.BETWEEN]
        marks.append(-1)
    return "".join(out), marks


def remembered(vocab: Vocabulary) -> Recent:
    """Ids of pieces, as decimal numbers joined by commas."""
    return Recent(lambda piece: ",".join(map(str, vocab.encode(piece.encode()))), REMEMBERED)


def encode(texts: list[str | None], vocab: Vocabulary, known: Recent) -> list[str]:
    """For each text its ids joined by commas."""
    joined, marks = segments(texts, vocab.special)
    found = pieces.split(joined)
    ends = [i for i, piece in enumerate(found) if piece == pieces.BETWEEN]
    out, line, start = [], [], 0
    for end, mark in zip(ends, marks):
        line += map(known.__getitem__, found[start:end])
        start = end + 1
        if mark >= 0:
            line.append(str(mark))
        else:
            out.append(",".join(line))
            line = []
    return out


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids of every text, and the text decoded from them: the columns ``keep``, ``ids`` (array),
    ``ids_text`` (joined by commas) and ``decoded``."""
    return _run(docs, path, keep, "ids array<int>, ids_text string, decoded string", lambda ids, decoded: (
        pa.array([[int(x) for x in t.split(",")] if t else [] for t in ids], pa.list_(pa.int32())), pa.array(ids), pa.array(decoded)))


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the number of ids, and digests of ids and decoded text."""
    def sha(values: list[str]) -> pa.Array:
        return pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())

    return _run(docs, path, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, decoded: (
        pa.array([t.count(",") + 1 if t else 0 for t in ids], pa.int64()), sha(ids), sha(decoded)))


def _run(docs: DataFrame, path: str, keep: tuple[str, ...], columns: str, build) -> DataFrame:
    rows = docs.select(*keep, docs["text"]) if "text" not in keep else docs.select(*keep)
    content = docs.sparkSession.sparkContext.broadcast(load(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(content.value)
        known = _memory(content.value)
        bytes_of = {str(i): b for i, b in vocab.bytes_of.items()}
        for part in slices(batches, "text"):
            ids = encode(part.column("text").to_pylist(), vocab, known)
            decoded = [b"".join(map(bytes_of.__getitem__, t.split(","))).decode("utf-8", "replace") if t else "" for t in ids]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *build(ids, decoded)], names=names)

    schema = extended(rows.select(*keep).schema, columns)
    names = schema.names
    return rows.mapInArrow(work, schema)


@lru_cache(2)
def _memory(content: bytes) -> Recent:
    return remembered(vocabulary(content))

"""Token counts by a finite-state machine compiled from a byte-pair vocabulary.

Two deterministic transducers stand behind each other. The first (``pieces.py``) cuts the text
into pieces; its chunk maps are composed by a parallel prefix scan. The second reads the bytes
of a piece; each of its transitions carries the number of tokens it adds (a later byte can also
take tokens back by joining them). A piece longer than a chunk is cut too: the map of a chunk says,
by entry state, the exit state and the tokens added, and a prefix scan composes these maps. A piece
within a chunk needs its map at one entry state only, the start, which is remembered by piece.

The second machine rests on two facts about byte-pair merges: the tokens of a prefix, up to the
start of its last token, are the tokens of that shorter prefix; and a row of tokens is the
encoding of its bytes if every adjacent pair is. So the last token of each prefix is enough. A
state holds, for every place from which a longer token may still begin: the position in the
tree of tokens, the last token before that place, and the count there against the count now.
States are compiled when first met and dropped together when there are ``MOST_STATES``; there are
too many to list, so the map of a chunk holds those entry states that the chunk may be met in.

Rows: a null text is empty and has 0 tokens. Nulls in ``doc_id`` and repeated rows pass
through, one result per row; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tradeframe.llm import pieces
from tradeframe.llm.bpe import Vocabulary, load, segments, vocabulary
from tradeframe.llm.common import Recent, extended, slices

MOST_STATES = 200_000
REMEMBERED = 300_000
#: Bytes of a chunk, and of the row of chunks that is composed at once.
CHUNK, ROW = 256, 65_536
#: The first guess of a chunk's entry state is the state after so many bytes before it.
WARM = 64
#: How often the maps learn the exit states of the chunks before them as new entry states.
ROUNDS = 4

Place = tuple[int, int, int]  # node in the tree, last token before it, count there minus count now


def scan(goes: np.ndarray, adds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose the rows of ``goes`` (column of the next row by column) from the left, and sum what
    ``adds`` says on the way: row i becomes the map of rows 0 to i, in doubling steps."""
    goes, adds, step = goes.copy(), adds.copy(), 1
    while step < len(goes):
        at = goes[:-step]
        adds[step:] = adds[:-step] + np.take_along_axis(adds[step:], at, axis=1)
        goes[step:] = np.take_along_axis(goes[step:], at, axis=1)
        step *= 2
    return goes, adds


class Machine:
    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.token: dict[int, int] = {}
        self.inner: set[int] = set()
        special, nodes = set(vocab.special.values()), 1
        for i, token in vocab.bytes_of.items():
            if i in special or vocab.encode(token) != [i]:
                continue
            node = 0
            for b in token:
                self.inner.add(node)
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.token[node] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self.counts = Recent(self.count, REMEMBERED)
        self.forget()

    def forget(self, *kept: tuple[Place, ...]) -> None:
        """Drop all states but the start, number 0, and ``kept``, from number 1."""
        start: tuple[Place, ...] = ((0, -1, 0),)
        self.states: list[tuple[Place, ...]] = [start, *kept]
        self.number = {places: i for i, places in enumerate(self.states)}
        self.moves: dict[int, tuple[int, int]] = {}  # state * 256 + byte: next state, tokens added

    def adjacent(self, a: int, b: int) -> bool:
        """May token ``b`` follow ``a`` in an encoding?"""
        if a < 0:
            return True
        if (known := self.follows.get((a, b))) is None:
            if len(self.follows) >= 1_000_000:
                self.follows.clear()
            bytes_of = self.vocab.bytes_of
            known = self.follows[a, b] = self.vocab.encode(bytes_of[a] + bytes_of[b]) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        last = added = None
        places: list[Place] = []
        for node, before, count in self.states[state]:
            if (node := self.child.get(node << 8 | byte)) is None:
                continue
            if last is None and (token := self.token.get(node)) is not None and self.adjacent(before, token):
                last, added = token, count + 1
            if node in self.inner:
                places.append((node, before, count))
        target = (*((node, before, count - added) for node, before, count in places), (0, last, 0))
        if (number := self.number.get(target)) is None:
            number = self.number[target] = len(self.states)
            self.states.append(target)
        move = self.moves[state << 8 | byte] = number, added
        return move

    def fold(self, state: int, data: bytes) -> tuple[int, int]:
        """The map of ``data`` at one entry state: exit state and tokens added."""
        total, get = 0, self.moves.get
        for byte in data:
            state, added = get(state << 8 | byte) or self.compile(state, byte)
            total += added
        return state, total

    def composed(self, state: int, data: bytes) -> tuple[int, int]:
        """The same by the maps of chunks and their composition.

        Each map starts with one guessed entry state and learns, in rounds over all chunks, the exit
        states of the map before it. An exit that the next map still does not know leads to a column
        of its own; if the true path ends there, the open chunks are folded from their true entries."""
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        guesses = [state, *(self.fold(0, chunk[-WARM:])[0] for chunk in chunks[:-1])]
        maps = [{s: self.fold(s, chunk)} for s, chunk in zip(guesses, chunks)]
        for _ in range(ROUNDS):
            new = [{s for s, _ in before.values()} - known.keys() for before, known in zip(maps, maps[1:])]
            if not any(new):
                break
            for known, chunk, entries in zip(maps[1:], chunks[1:], new):
                known.update({s: self.fold(s, chunk) for s in entries})
        unknown = max(map(len, maps))
        goes = np.full((len(maps), unknown + 1), unknown)
        adds = np.zeros((len(maps), unknown + 1), np.int64)
        for i, (found, after) in enumerate(zip(maps, [*maps[1:], None])):
            column = {s: j for j, s in enumerate(after)} if after else {}
            for j, (s, added) in enumerate(found.values()):
                # the last map keeps its own columns: nothing comes after it
                goes[i, j], adds[i, j] = column.get(s, unknown) if after else j, added
        goes, adds = scan(goes, adds)
        if (last := goes[-1, 0]) != unknown:
            return list(maps[-1].values())[last][0], int(adds[-1, 0])
        total = 0
        for known, chunk in zip(maps, chunks):
            state, added = known.get(state) or self.fold(state, chunk)
            total += added
        return state, total

    def count(self, piece: str) -> int:
        data = piece.encode()
        state = total = 0
        for i in range(0, len(data), ROW):
            row = data[i : i + ROW]
            if len(self.states) > MOST_STATES:
                self.forget(*(self.states[state],) if state else ())
                state = min(state, 1)
            state, added = self.composed(state, row) if len(row) > CHUNK else self.fold(state, row)
            total += added
        return total


@lru_cache(2)
def machine(content: bytes) -> Machine:
    return Machine(vocabulary(content))


def count(texts: list[str | None], counter: Machine) -> list[int]:
    joined, marks = segments(texts, counter.vocab.special)
    out, total = [], 0
    found = pieces.split(joined)
    ends = [i for i, piece in enumerate(found) if piece == pieces.BETWEEN]
    start, known = 0, counter.counts.__getitem__
    for end, mark in zip(ends, marks):
        total += sum(map(known, found[start:end]))
        start = end + 1
        if mark >= 0:
            total += 1
        else:
            out.append(total)
            total = 0
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``)."""
    rows = docs.select("doc_id", "text")
    content = docs.sparkSession.sparkContext.broadcast(load(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = machine(content.value)
        for part in slices(batches, "text"):
            text = part.column("text")
            sizes = pc.fill_null(pc.cast(pc.binary_length(text), pa.int64()), 0)
            n = pa.array(count(text.to_pylist(), counter), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, n, pc.greater(n, limit)], names=names)

    schema = extended(rows.select("doc_id").schema, "n_bytes long, n_tokens long, over_limit boolean")
    names = schema.names
    return rows.mapInArrow(work, schema)

"""The splitting step of the byte-level tokenizer as a deterministic transducer.

The tokenizer cuts a text into pieces before any merge: contractions, runs of letters, of
numbers and of other marks (each with one space in front), and white space. Here this is a
finite machine over character classes. A transition says whether a piece begins at the
character just read (``HERE``), at the one before it (``BACK``), or both; the delay of one
character decides white space before a word and contractions such as ``'re``.

A batch of texts is one row of characters, cut into chunks of equal length. For each chunk
the map from every entry state to its exit state is computed, all chunks in step; an
associative scan over these maps gives each chunk's true entry state.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

LETTER, ENDS, R, V, E, LL, NUMBER, MARK, APOS, SPACE, BLANK, STOP = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_MARKS, ONE_SPACE, ONE_BLANK, TO_SPACE, TO_BLANK, AT_APOS, APOS_R, APOS_L, CONTRACTED = range(12)
HERE, BACK = 1, 2
#: Stands between texts; never part of a text that Spark holds.
BETWEEN = "\ud800"

# White space, and the letters and numbers of Unicode 16 that Python's tables (15.1) lack.
WHITE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(9, 14)]
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.full(sys.maxunicode + 1, MARK, np.uint8)
    for c in range(sys.maxunicode + 1):
        if (k := kind.get(unicodedata.category(chr(c))[0])) is not None:
            table[c] = k
    for ranges, k in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = k
    table[WHITE] = BLANK
    for letters, k in (("stmd", ENDS), ("r", R), ("v", V), ("e", E), ("l", LL), ("'", APOS), (" ", SPACE), (BETWEEN, STOP)):
        table[[ord(x) for x in letters]] = k
    return table


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted marks by (class, state)."""
    fresh = {NUMBER: IN_NUMBERS, MARK: IN_MARKS, APOS: AT_APOS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, STOP: START}
    fresh |= dict.fromkeys((LETTER, ENDS, R, V, E, LL), IN_LETTERS)
    goes = np.zeros((12, 12), np.uint8)
    says = np.zeros((12, 12), np.uint8)
    for x, target in fresh.items():  # a new piece, unless said otherwise below
        goes[x], says[x] = target, HERE

    def put(state: int, inputs, target: int | None = None, marks: int = 0) -> None:
        for x in inputs:
            goes[x, state] = fresh[x] if target is None else target
            says[x, state] = marks

    letters, words = (LETTER, ENDS, R, V, E, LL), (LETTER, ENDS, R, V, E, LL, NUMBER, MARK)
    put(IN_LETTERS, letters)
    put(IN_NUMBERS, [NUMBER])
    put(IN_MARKS, [MARK, APOS], IN_MARKS)
    for state, marks in ((ONE_SPACE, 0), (TO_SPACE, BACK)):  # the space goes with what follows
        put(state, words, marks=marks)
        put(state, [APOS], IN_MARKS, marks)
    put(TO_BLANK, (*words, APOS), marks=HERE | BACK)
    for state in (ONE_SPACE, ONE_BLANK, TO_SPACE, TO_BLANK):
        put(state, [SPACE], TO_SPACE)
        put(state, [BLANK], TO_BLANK)
    put(AT_APOS, [MARK, APOS], IN_MARKS)
    put(AT_APOS, [ENDS], CONTRACTED)
    put(AT_APOS, [R, V], APOS_R, 0)
    put(AT_APOS, [LL], APOS_L, 0)
    for state, last in ((APOS_R, E), (APOS_L, LL)):
        put(state, fresh, marks=HERE | BACK)
        put(state, letters, marks=BACK)
        put(state, [last], CONTRACTED)
    return goes, says


def scan(maps: np.ndarray) -> np.ndarray:
    """Compose ``maps`` (one row per chunk: exit state by entry state) from the left: row i
    becomes the map of chunks 0 to i. Doubling steps, each over all rows at once."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def starts(text: str, length: int = 512) -> np.ndarray:
    """Positions at which pieces of ``text`` begin; ``BETWEEN`` is a piece of its own."""
    if not text:
        return np.zeros(0, np.int64)
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = -(-n // length)
    kinds = np.full(rows * length, STOP, np.uint8)
    kinds[:n] = classes()[codes]
    kinds = np.ascontiguousarray(kinds.reshape(rows, length).T)  # one row per step
    goes, says = transitions()
    goes, says = goes.ravel(), says.ravel()
    base = kinds.astype(np.uint16) * 12

    maps = np.tile(np.arange(12, dtype=np.uint8), (rows, 1))
    at = 0
    while at < length and not (maps == maps[:, :1]).all():
        maps = goes[base[at][:, None] + maps]
        at += 1
    one = maps[:, 0]
    for t in range(at, length if at < length else 0):  # all entries agree: one state stands for twelve
        one = goes[base[t] + one]
    if at < length:
        maps = np.repeat(one[:, None], 12, axis=1)
    state = np.empty(rows, np.uint8)
    state[0] = START
    state[1:] = scan(maps)[:-1, START]

    marks = np.empty((length, rows), np.uint8)
    for t in range(length):
        key = base[t] + state
        marks[t] = says[key]
        state = goes[key]
    flat = np.ascontiguousarray(marks.T).reshape(-1)
    begins = (flat[:n] & HERE).astype(bool)
    back = (flat[1:] & BACK).astype(bool)
    begins[: len(back)] |= back[:n]
    if flat.size > n:
        pass  # the padding is STOP, which decides what the last character left open
    elif APOS_R <= state[-1] <= APOS_L:
        begins[n - 1] = True
    begins[0] = True
    return np.flatnonzero(begins)


def split(text: str) -> list[str]:
    at = starts(text).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]

"""Packing against the tokenizers library and the rules of best-two-fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from tradeframe.llm import bpe, packing
from tradeframe.llm.queries import vocabulary_path

RANKS = vocabulary_path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def check(rows, texts, library, limit=packing.LIMIT):
    """``rows``: (doc_id, piece, start, length, ids crc, sequence, offset). Documents are told apart by id and pieces."""
    want = defaultdict(list)
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % limit or limit
        cuts = [0, *range(first, len(ids), limit), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i].append((n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    found, places = defaultdict(list), defaultdict(list)
    for i, n, start, length, crc, sequence, offset in rows:
        found[i].append((n, start, length, crc))
        places[sequence].append((offset, length))
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in want.items()}
    for line in places.values():
        at = 0
        for offset, length in sorted(line):
            assert offset == at
            at += length
        assert at <= limit
    return len(places)


def test_the_sample(spark, sample, library):
    rows = [tuple(r) for r in packing.placements(sample, RANKS, PATTERN, SPECIAL).collect()]
    texts = [(r["doc_id"], r["text"]) for r in sample.collect()]
    n = check(rows, texts, library)
    assert n <= 1.025 * sum(r[3] for r in rows) / packing.LIMIT  # little room is left over, even by 200 documents


@pytest.mark.parametrize("limit", [7, 64])
def test_odd_rows_and_short_sequences(spark, odd_docs, no_docs, texts, library, limit):
    found = packing.placements(odd_docs.repartition(5), RANKS, PATTERN, SPECIAL, limit)
    assert found.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"),
                            ("sequence_id", "bigint"), ("offset", "bigint")]
    check([tuple(r) for r in found.collect()], texts, library, limit)
    assert packing.placements(no_docs, RANKS, PATTERN, SPECIAL, limit).count() == 0


def test_ids_are_those_of_the_library(spark, odd_docs, texts, library):
    rows = packing.sequences(odd_docs, RANKS, PATTERN, SPECIAL, 50).filter("doc_id = 5").orderBy("piece").collect()
    assert [x for r in rows for x in r["ids"]] == [*library.encode(dict(texts)[5], add_special_tokens=False).ids, 2]
    assert bpe.vocabulary(bpe.load(vocabulary_path())).special == SPECIAL


def test_code_points(library):
    """The vocabulary as ranks gives the library's ids next to characters of every class."""
    with open(RANKS, "rb") as file:
        encoder = packing.encoder(file.read(), PATTERN, tuple(SPECIAL.items()))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    lines = [f"x{chr(c)}y1{chr(c)}2 {chr(c)} {chr(c)}{chr(c)}  {chr(c)}'" for c in points[:0x3400:3] + points[0x3400::41]]
    lines += ["'s" * 400, "a" * 5000, " " * 5000, "<|endoftext|>", " <|endoftext|>\n<|endoftext", "\r\n\t x"]
    for line, found in zip(lines, library.encode_batch(lines, add_special_tokens=False)):
        assert encoder.encode(line, allowed_special="all") == found.ids


def test_two_better_than_the_shortest():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 1]] = 1, 1, 1
    assert packing.filled(counts) == {7: 1, 2: 1, 1: 1}
    counts[:] = 0
    counts[[6, 3, 2]] = 1, 1, 2  # 6 and 3 leave a gap of 1 that nothing fits: 3 gives way to 2 and 2
    assert packing.filled(counts) == {6: 1, 2: 2}
    counts[2] = 1  # one 2 can't stand twice
    assert packing.filled(counts) == {6: 1, 3: 1}


def one_by_one(lengths, limit):
    """Best-two-fit on single pieces: the number of sequences."""
    counts = np.bincount(lengths, minlength=limit + 1)
    n = 0
    while counts.any():
        for length, uses in packing.filled(counts).items():
            counts[length] -= uses
        n += 1
    return n


def test_repeated_sequences_are_as_good_as_single_ones():
    random.seed(3)
    for most, n in ((100, 800), (40, 500), (64, 300)):
        lengths = [random.randint(1, most) for _ in range(n)]
        plan = packing.plan(np.bincount(lengths, minlength=101))
        ranks = defaultdict(list)
        for length, first, last, uses, base, _ in plan:
            ranks[length] += range(first, last)
            assert (last - first) % uses == 0
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(lengths.count(k))) for k in set(lengths)}
        sequences = max(base + (last - first) // uses for _, first, last, uses, base, _ in plan)
        assert sequences <= one_by_one(lengths, 100) + 1
    millions = np.zeros(1025, np.int64)
    millions[1:] = 10**9 + 7 * np.arange(1024)
    assert len(packing.plan(millions)) < 20_000

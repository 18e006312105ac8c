"""Splitting, encoding and counting against the tokenizers library."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradeframe.llm import bpe, pieces, token_counts
from tradeframe.llm.queries import vocabulary_path

ALPHABET = "ab'strvelmd  \n\t1! é日  <|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(bpe.load(vocabulary_path()))


@pytest.fixture(scope="module")
def hard(sample):
    random.seed(5)
    made = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 200))) for _ in range(300)]
    made += ["", "a" * 2000, "'s" * 300, "é" * 300 + " " * 300, "<|endoftext|>a<|endoftext|>", "x  <|endoftext|>  y", "<|endoftext", "՘\U0001CCF0x"]
    return made + [r["text"] for r in sample.collect()]


@pytest.mark.parametrize("length", [3, 64, 512])
def test_pieces_in_chunks(library, length):
    random.seed(length)
    for _ in range(300):
        text = "".join(random.choice(ALPHABET) for _ in range(random.randint(1, 60)))
        at = pieces.starts(text, length).tolist()
        found = [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
        assert found == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_classes_of_all_code_points(library):
    kinds, split = pieces.classes(), library.pre_tokenizer.pre_tokenize_str
    for c in [*range(0x3000), *range(0xA000, 0xD800), *range(0xF900, 0x20000, 7), *(x for a, b in pieces.NEW_LETTERS + pieces.NEW_NUMBERS for x in (a, b))]:
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = "L" if len(split("a" + ch)) == 1 else "N" if len(split("1" + ch)) == 1 else "M" if len(split("!" + ch)) == 1 else "S"
        ours = "L" if kinds[c] <= pieces.LL else "N" if kinds[c] == pieces.NUMBER else "M" if kinds[c] in (pieces.MARK, pieces.APOS) else "S"
        assert ours == kind, hex(c)


def test_encode_like_the_library(library, vocab, hard):
    want = [e.ids for e in library.encode_batch(hard, add_special_tokens=False)]
    got = bpe.encode(hard, vocab, bpe.remembered(vocab))
    assert got == [",".join(map(str, ids)) for ids in want]
    for text, ids in zip(hard, want):
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_long_pieces_take_the_same_merges(vocab):
    random.seed(2)
    for _ in range(50):
        parts = [vocab.of_byte[random.choice(b"aeinrst th")] for _ in range(200)]
        assert vocab.scanned(list(parts)) == vocab.heaped(list(parts))


def test_machine_counts_like_the_library(library, vocab, hard):
    machine = token_counts.Machine(vocab)
    assert token_counts.count(hard, machine) == [len(e.ids) for e in library.encode_batch(hard, add_special_tokens=False)]


def test_machine_forgets_states(library, vocab, hard, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    machine = token_counts.Machine(vocab)
    assert token_counts.count(hard[:100], machine) == [len(e.ids) for e in library.encode_batch(hard[:100], add_special_tokens=False)]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_chunk_maps_compose_to_the_count_of_long_pieces(library, vocab, monkeypatch, rounds):
    monkeypatch.setattr(token_counts, "CHUNK", 8)
    monkeypatch.setattr(token_counts, "WARM", 3)
    monkeypatch.setattr(token_counts, "ROW", 100)
    monkeypatch.setattr(token_counts, "ROUNDS", rounds)
    monkeypatch.setattr(token_counts, "MOST_STATES", 300)
    random.seed(rounds)
    words = ["the", "ing", "a", "aa", "zq", "é", "日本", "tion", "Straße"]
    long = ["".join(random.choice(words) for _ in range(random.randint(1, 300))) for _ in range(60)] + ["a" * 5000, "-" * 999, "日" * 700, " " * 800]
    machine = token_counts.Machine(vocab)
    assert [machine.count(x) for x in long] == [len(library.encode(x, add_special_tokens=False).ids) for x in long]
    state, data = 0, long[0].encode()
    assert machine.composed(state, data) == machine.fold(state, data)


def test_a_text_without_blanks(library, vocab):
    random.seed(9)
    text = "".join(random.choice("abcdefghijklmnopqrstuvwxyzäöüß") for _ in range(150_000))
    assert token_counts.count([text], token_counts.Machine(vocab)) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_operators_on_odd_rows(odd_docs, no_docs, texts, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in texts}
    found = Counter(map(tuple, bpe.digests(odd_docs, vocabulary_path()).collect()))
    assert found == Counter((i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(t or "")) for i, t in texts)
    found = Counter(map(tuple, token_counts.token_counts(odd_docs, vocabulary_path()).collect()))
    assert found == Counter((i, len((t or "").encode()), len(ids[t]), len(ids[t]) > 1024) for i, t in texts)
    for r in bpe.encoded(odd_docs, vocabulary_path(), ("doc_id", "text")).collect():
        assert r["ids"] == ids[r["text"]] and r["decoded"] == (r["text"] or "")
    assert bpe.digests(no_docs, vocabulary_path()).count() == 0
    assert token_counts.token_counts(no_docs, vocabulary_path()).count() == 0


def test_limit(sample):
    rows = token_counts.token_counts(sample, vocabulary_path(), limit=100)
    assert rows.filter(F.col("over_limit") != (F.col("n_tokens") > 100)).isEmpty()

"""Ranked search against all scores in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import duck, run

from tradeframe.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(x for _, _, x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, size in counts:
            m = 100 - 90 + 90 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:10], 1)]
    return Counter(out)


def found(docs, items, **more):
    return Counter(map(tuple, lexical_search.search(docs, items, **more).collect()))


@pytest.mark.parametrize("segment", [300, 2_000_000])
def test_the_sample(spark, sample, monkeypatch, segment):
    monkeypatch.setattr(lexical_search, "SEGMENT", segment)  # many segments in a task: skipped by their bounds
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = brute([(r["doc_id"], r["text"]) for r in sample.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert found(sample.coalesce(1), items) == rows
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found(sample.repartition(6), items, most=300) == rows  # several blocks of items


def test_ties_and_common_words(spark):
    random.seed(4)
    some = [f"w{i}" for i in range(12)] + ["common"] * 30
    docs = [(i, " ".join(random.choice(some) for _ in range(random.randint(1, 8)))) for i in range(400)]
    docs += [(i, "common w1 w2") for i in range(1000, 1100)]
    items = [(i, " ".join(random.sample(some, 6))) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(frame, asked) == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs, texts):
    items = [(1, "The CAT, one passage wörds"), (2, None), (3, ""), (4, "nowhere to be found"), (None, "another text"), (1, "日本語 p3"), (1, "cat")]
    asked = spark.createDataFrame([(*r, 1, 2, 3) for r in items], "item_id long, text string, doc_id long, score long, rank int")
    assert found(odd_docs, asked) == brute(texts, items)
    assert found(odd_docs, asked.limit(0)) == found(no_docs, asked) == Counter()
    assert lexical_search.search(odd_docs, asked.limit(0)).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_very_long_texts(spark):
    docs = [(1, "alpha beta " * 60_000), (2, "alpha"), (3, "x" * 500_000)]
    items = [(7, "alpha beta " + "x" * 500_000)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def segment(docs, weights, items):
    size = [len(d) for d in docs]
    asked = lexical_search.Questions(items, np.array(weights), 100, 1000)
    n = np.array([sum(d.values()) for d in docs], np.int64)
    term = np.array([t for d in docs for t in sorted(d)], np.int64)
    tf = np.array([d[t] for d in docs for t in sorted(d)], np.int64)
    return asked, lexical_search.Segment(asked, n, np.array(size), term, tf)


def test_pair_bounds_are_tighter_than_two_maxima_and_skip():
    docs = [{0: 5}, {1: 5}, {0: 1, 1: 1, 2: 9}]  # no document has terms 0 and 1 at their best
    asked, index = segment(docs, [10, 10, 1], [[0, 1]])
    apart = index.top[0] + index.top[1]
    scores = {int(d): int(s) for d, s in zip(*index.best(asked.units[0], 1))}
    assert index.joint[0, 1] == max(scores.values()) < apart
    nothing, _ = index.best(asked.units[0], index.joint[0, 1] + 1)  # below the two maxima, yet skipped
    assert len(nothing) == 0 and index.joint[0, 1] + 1 < apart
    assert not index.scratch.any()


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    diff, rows, _ = run(spark, folder, "op12", queries.QUERIES["op12_lexical_search"], queries.SQL["op12_lexical_search"], duck(folder))
    assert diff is None and rows == 400

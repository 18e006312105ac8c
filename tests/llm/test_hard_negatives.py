"""Hard negatives against all products in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import duck, run
from pyspark.sql import functions as F

from tradeframe.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    some = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        some.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, v in {r for r in some if r[0] % 100 == 0}:
        scores = {(-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in some if j != i}
        positives = sorted((s, j) for s, j, same in scores if same)[:5]
        for p, j in positives:
            fits = sorted((s, k) for s, k, same in scores if not same and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fits, 1)]
    return Counter(out)


def found(frame):
    return Counter(map(tuple, hard_negatives.mined(frame).collect()))


def clustered(n, seed, width=6, copies=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(10, width))
    rows = [(i, (middles[i % 10] + 0.3 * rng.normal(size=width)).tolist(), int(rng.integers(10)) if i % 3 == 0 else i % 10) for i in range(n)]
    return rows + [(n + i, rows[0][1], i % 4) for i in range(copies)]


@pytest.mark.parametrize("block, wave", [(512, 64_000_000), (4, 900)])
def test_clusters_and_copies(spark, monkeypatch, block, wave):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "WAVE", wave)  # several waves
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    rows = clustered(1200, 1, copies=300)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert found(frame) == want and len(want) > 50


def test_bounds_leave_rows_out(monkeypatch):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(40, 4)) * 3 + 200).astype(np.int64)  # close together: edges are short
    block = hard_negatives.tree(pa.table({"vec_id": range(40), "label": [1] * 40, "v": v.tolist(), "block": [5] * 40}))
    tree = hard_negatives.trees(block)[0]
    at = np.array(tree.ids)
    assert (tree.rows == v[at]).all() and tree.parent[0] == -1 and all(p < i for i, p in enumerate(tree.parent))
    others = rng.integers(-300, 300, size=(500, 4))
    rows = hard_negatives.Rows(np.arange(500), others, hard_negatives.norms(others), tree.norm())
    true = others @ tree.rows.T
    scored = 0

    def wanted(place, low, high):
        assert (low <= true[:, place]).all() and (true[:, place] <= high).all()
        return (high >= 100_000) & (low <= 120_000)

    for place, which, score in hard_negatives.walked(tree, rows, wanted):
        assert (score == true[which, place]).all()
        assert set(np.flatnonzero((true[:, place] >= 100_000) & (true[:, place] <= 120_000))) <= set(which.tolist())
        scored += len(which)
    assert scored < 500 * 40 / 3


def test_tree_is_a_least_one():
    v = [[0, 0], [10, 0], [11, 0], [0, 9], [0, 30]]
    found = hard_negatives.tree(pa.table({"vec_id": range(5), "v": v}))
    assert sorted(round(e) for e in found.column("edge").to_pylist()) == [0, 1, 9, 10, 21]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    random.seed(2)
    rows = [(i, [random.uniform(-1, 1) for _ in range(3)], i % 3) for i in range(60)]
    rows += [(100, [1.0, 0.5, 0.2], None), (200, None, 1), (300, [1.0, None, 0.1], 1), (400, [nan, 1.0, 1.0], 1), (500, [inf, 0.0, 0.0], 1),
             (None, [1.0, 1.0, 1.0], 1), (600, [], 1), (700, [1.0], 0), (800, [0.5, 0.5, 0.5, 9.0], 2), (-100, [0.1, 0.9, 0.4], 1), (-7, [1.0, 1.0, 0.9], 1)]
    rows += [rows[0], rows[0], rows[5], (5, [0.3, 0.3, 0.3], 2)]  # repeated rows, and an id with two vectors
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", anchor_id int, place int, v string")
    assert found(frame) == brute(rows)
    assert hard_negatives.mined(frame).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(frame.limit(0)) == found(frame.filter("vec_id = 5")) == found(frame.filter(F.col("vec_id") == 0)) == Counter()


def test_scores_beyond_the_exact_range_of_doubles(spark):
    rows = [(i, [2.0**22 + i, 2.0**21 - 3 * i, 1.0], i % 2) for i in range(101)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    beyond = [(i, [2.0**40, 2.0**30 + i], i % 2) for i in range(11)]  # all scores are the largest
    assert set(found(spark.createDataFrame(beyond, SCHEMA))) == {(0, p, n, k, 2**63 - 1, 2**63 - 1)
                                                                 for p in (1, 3, 5, 9) for n, k in enumerate((2, 4, 6, 7, 8), 1)}


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    diff, rows, _ = run(spark, folder, "op13", queries.QUERIES["op13_hard_negatives"], queries.SQL["op13_hard_negatives"], duck(folder))
    assert diff is None and rows > 20

"""Decontamination, substring and near-copy search against plain dictionaries."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tradeframe.llm import common, components, decontaminate, simhash, substring_dedup

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


# decontamination

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows, items, size=10):
    known = {}
    for i, text in items:
        w = TOKEN.findall((text or "").translate(LOW))
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            known.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, text in rows:
        w = TOKEN.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in known}:
            for k in range(len(w) - n + 1):
                if of := known.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= {x for x in of if x is not None}
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_leaks_of_the_sample(spark, sample):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = Counter(map(tuple, decontaminate.report(sample, items).collect()))
    assert found == leaks(pairs(sample), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sum(n for r, n in found.items() if r[5]) > 0


def test_leaks_in_odd_rows(spark, odd_docs, no_docs, texts):
    passage = " ".join(f"P{i}," for i in range(12))
    rows = [(1, passage, 1), (1, passage, 1), (2, None, 1), (3, "", 1), (4, "short item", 1), (None, "the cat sat on the mat", 1), (5, "a a a a a a a a a a a", 1), (20, "text of the", 1), (6, "!!", 1)]
    items = spark.createDataFrame(rows, "item_id long, text string, doc_id int")
    found = Counter(map(tuple, decontaminate.report(odd_docs, items).collect()))
    assert found == leaks(texts, [r[:2] for r in rows])
    assert decontaminate.report(no_docs, items).count() == 0
    none = decontaminate.report(odd_docs, items.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["contaminated"] for r in none)
    left = decontaminate.clean(odd_docs, items)
    assert left.columns == odd_docs.columns
    bad = {r[0] for r, _ in found.items() if r[5]}
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, t in texts if not any(r[5] for r in leaks([(i, t)], [x[:2] for x in rows])))
    assert bad


def test_items_by_number_sort_as_text(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha"), (10, "beta"), (9, "gamma")], "item_id long, text string")
    row = decontaminate.report(docs, items).first()
    assert row["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and row["n_hit"] == 3


# repeated windows

def without_repeats(rows):
    order = lambda i: (i is not None, i or 0)
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 19):
            key, place = tuple(w[k : k + 20]), (*order(i), k)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (*order(i), k):
                gone[k : k + 20] = [True] * 20
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("settings", [{}, {"block": 20_000, "hot": 2}, {"block": 1, "hot": 10**9}])
def test_repeats_of_the_sample(sample, settings):
    found = substring_dedup.deduplicated(sample, **settings).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    found = Counter(map(tuple, found.collect()))
    assert found == without_repeats(pairs(sample))
    assert sum(r[2] for r in found) > 0


def test_repeats_in_odd_rows(odd_docs, no_docs, texts):
    found = substring_dedup.deduplicated(odd_docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert Counter(map(tuple, found.collect())) == without_repeats(texts)
    assert substring_dedup.deduplicated(no_docs).count() == 0


def test_periodic_and_shifted_texts(spark):
    random.seed(4)
    base = [random.choice("abc") for _ in range(400)]
    rows = [(k, " ".join(base[s : s + n])) for k, (s, n) in enumerate([(0, 400), (7, 100), (50, 20), (50, 19), (380, 20), (0, 60)])]
    rows += [(10, "x " * 25), (11, "x y " * 40), (12, "x y z " * 30), (9, "x " * 20), (13, "q " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in ({}, {"hot": 1}):
        found = substring_dedup.deduplicated(docs, **settings).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        assert Counter(map(tuple, found.collect())) == without_repeats(rows)


def test_equal_hashes_are_told_apart(monkeypatch, spark, sample):
    """With hashes of three bits nearly all windows collide; words still decide."""
    real = substring_dedup.mixed
    monkeypatch.setattr(substring_dedup, "mixed", lambda x: real(x) & np.uint64(7))
    rows = pairs(sample.limit(40))
    tables = substring_dedup.pa.table({"string": [(t or "").encode() for _, t in rows], "block": [0] * len(rows), "key": list(range(len(rows))),
                                       "doc": [i for i, _ in rows], "start": [0] * len(rows), "more": [False] * len(rows)})
    answers = substring_dedup.settled(tables).to_pylist()
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), []).append((i, k))
    want = {(i, k): min(p) for p in first.values() if len(p) > 1 for i, k in p}
    id_of = {substring_dedup.digest((t or "").encode()): i for i, t in rows}
    assert {(id_of[a["digest"]], a["j"] + x): (a["first_doc"], a["first_start"] + x) for a in answers for x in range(a["n"])} == want


# near copies

def fingerprint(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(prints):
    """A name for the group of each fingerprint, over chains of links, comparing all with all."""
    u = np.array(sorted({p for _, p in prints}), np.uint64)
    root = {int(x): int(x) for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in u:
        for y in u[np.bitwise_count(u ^ x) <= 3]:
            root[find(int(y))] = find(int(x))
    return {p: find(p) for _, p in prints}


def classes(prints):
    """Smallest id by fingerprint."""
    group, least = groups(prints), {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    return {p: least.get(group[p]) for _, p in prints}


def check_groups(frame, rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    least = classes(prints)
    assert Counter(map(tuple, simhash.grouped(frame).collect())) == Counter((i, f"{p:016x}", least[p]) for i, p in prints)


def test_groups_of_the_sample(sample):
    check_groups(sample, pairs(sample))


def test_a_large_key_meets_the_other_side_in_parts(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'big', concat('k', id % 90)) as key")
    others = rows.filter("key != 'k1'").select("key").distinct().withColumn("value", F.concat(F.lit("v"), "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    want = Counter((r["id"], r["key"], None if r["key"] == "k1" else "v" + r["key"]) for r in rows.collect())
    for per_part in (1, 50, 10_000):
        found = common.met(rows, sizes, others, "key", F.xxhash64("id"), "left", per_part).select("id", "key", "value")
        assert Counter(map(tuple, found.collect())) == want
        inner = common.met(rows, sizes, others, "key", F.xxhash64("id"), "inner", per_part).select("id", "key", "value")
        assert Counter(map(tuple, inner.collect())) == Counter({k: n for k, n in want.items() if k[2]})


def test_groups_of_odd_rows(odd_docs, no_docs, texts):
    check_groups(odd_docs, texts)
    assert simhash.grouped(no_docs).count() == 0
    left = simhash.representatives(odd_docs)
    assert left.columns == odd_docs.columns
    prints = [(i, fingerprint(t)) for i, t in texts]
    group, least = groups(prints), classes(prints)
    # two groups may have the same least id: a row for each group
    assert Counter(r["doc_id"] for r in left.collect()) == Counter({group[p]: least[p] for _, p in prints}.values())


def test_groups_of_the_same_least_id_keep_a_row_each(spark):
    a, b = "the first text of this id is about ships and harbours", "quite another text whose words are of mountains and snow"
    docs = spark.createDataFrame([(5, a), (5, b), (7, b), (5, a)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.representatives(docs).collect())) == sorted([(5, a), (5, b)])
    # 5 is in the group of 3 as well: there it goes, and in its own group it stays, whichever row comes first
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b)], "doc_id long, text string")
    for rows in (docs, docs.orderBy(F.desc("doc_id"), "text"), docs.orderBy(F.desc("doc_id"), F.desc("text"))):
        assert sorted(map(tuple, simhash.representatives(rows).collect())) == sorted([(3, a), (5, b)])


def test_near_prints_in_chains_and_a_dense_group(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << rng.randrange(64)) for _ in range(60)} | {base}
    chain = rng.getrandbits(64)
    for _ in range(25):  # a long chain, three bits a step
        for _ in range(3):
            chain ^= 1 << rng.randrange(64)
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(3000)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["fp"] % (1 << 64): r["root"] for r in simhash.near_groups(frame).collect()}
    want = classes([(x, x) for x in prints])
    together = Counter(want.values())
    assert set(found) == {x for x in prints if together[want[x]] > 1}
    by_root = {}
    for x, r in found.items():
        by_root.setdefault(r, set()).add(want[x])
    assert all(len(v) == 1 for v in by_root.values()) and len(by_root) == len({want[x] for x in found})


def test_homes_meet():
    rng = np.random.default_rng(1)
    value = rng.integers(0, 1 << 31, 500, dtype=np.uint64)
    home, far = simhash.anchors(value)
    assert (np.bitwise_count(value ^ home) <= 1).all() and (np.bitwise_count(value[:, None] ^ far) <= 2).all()
    for i in range(31):
        near, others = simhash.anchors(value ^ np.uint64(1 << i))
        assert ((near == home) | (others == home[:, None]).any(axis=1)).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (10, 9), (9, 8), (8, 3), (2, 1)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys((1, 2, 3, 8, 9, 10), 1), **dict.fromkeys((4, 5, 6), 4)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tradeframe.llm import toxicity


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_in_every_language(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.toxicity(docs, labels).join(docs.select("doc_id", "lang", "text"), "doc_id").join(labels, "doc_id").filter("held_out and toxic is not null").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert (toxic.predicted == 1).mean() >= 0.95
    assert (clean.predicted == 0).mean() >= 0.98
    for lang, some in toxic.groupby("lang"):
        assert (some.predicted == 1).mean() >= (0.9 if len(some) >= 20 else 0.75), lang
        assert (clean[clean.lang == lang].predicted == 0).mean() >= 0.95, lang
    assert ((found.score >= 0) & (found.score <= 1)).all() and (found.predicted == (found.score >= 0.3)).all()


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"good words {i} here" if i % 2 else f"awful rude words {i} here") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, i % 2 if held(i) else 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    a = {r["doc_id"]: tuple(r) for r in toxicity.toxicity(docs, labels).collect()}
    b = {r["doc_id"]: tuple(r) for r in toxicity.toxicity(docs, turned).collect()}
    assert {i for i, r in a.items() if r[1]} == {i for i in range(200) if held(i)}
    assert all(a[i][2] == pytest.approx(b[i][2], abs=1e-9) for i in a)


def test_odd_rows(spark, odd_docs, no_docs, texts):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 1), (5, 0, 1), (6, 0, 1), (7, 1, 1), (None, 1, 0), (99, 1, 1)], "doc_id long, toxic int, score int")
    found = toxicity.toxicity(odd_docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in texts)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in found)
    empty = {r["score"] for r in found if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0.0}


def plain_weights(texts):
    """``texts``: (toxic, words). The weight of a word, from dictionaries of beginnings."""
    count, many = {}, Counter()
    for toxic, line in texts:
        for w in line:
            s = (w + bytes(toxicity.DEPTH))[: toxicity.DEPTH]
            for k in range(len(s) + 1):
                count.setdefault(s[:k], [0, 0])[1 - toxic] += 1
        for w in {(w + bytes(toxicity.DEPTH))[: toxicity.DEPTH] for w in line}:
            many.update(w[:k] for k in range(len(w) + 1))

    def weight(w):
        s, total = (w + bytes(toxicity.DEPTH))[: toxicity.DEPTH], 0.0
        for k in range(1, len(s) + 1):
            h, g = s[: k - 1], s[:k]
            if g not in count:
                break
            children = [x for x in count if len(x) == k and x.startswith(h)]
            shared = many[g] / sum(many[x] for x in children)
            chance = []
            for c in (0, 1):
                ways = sum(count[x][c] > 0 for x in children)
                chance.append((max(count[g][c] - 0.75, 0) + 0.75 * ways * shared) / count[h][c] if count[h][c] else shared)
            total += np.log(chance[0] / chance[1])
        return total
    return weight


def test_fit_from_raw_texts(spark):
    random.seed(8)
    letters = "abcé"
    rows = [(random.randint(0, 1), " ".join("".join(random.choice(letters) for _ in range(random.choice([1, 2, 3, 4, 30]))) for _ in range(12))) for _ in range(40)]
    model = toxicity.fit(spark.createDataFrame(rows, "toxic int, text string"))
    weight = plain_weights([(t, toxicity.words(x)) for t, x in rows])
    asked = sorted({w for _, x in rows for w in toxicity.words(x)}) + [b"zzz", b"ab", b"a" * 40, "éé".encode(), b"abcz"]
    assert model.weigh(asked) == pytest.approx([weight(w) for w in asked])


def test_a_stem_with_ever_other_endings(spark):
    """Rare words count through their stem: no ending is seen twice."""
    random.seed(1)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "pa", "ri", "so", "ta"]

    def word(n):
        return "".join(random.choice(syllables) for _ in range(n))

    def text(marks):
        line = [word(random.randint(1, 4)) for _ in range(80)] + ["vorgu" + word(4) for _ in range(marks)]
        random.shuffle(line)
        return " ".join(line)

    docs = spark.createDataFrame([(i, text(3 if i % 5 == 0 else 0)) for i in range(1500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500) if i < 1000 or held(i)], "doc_id long, toxic int")
    found = [r for r in toxicity.toxicity(docs, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in found]) > 0.97


def test_evidence_by_hand():
    hashed = {w: [int(h[0]) for h in toxicity.hashes(toxicity.spelled([w]))] for w in (b"bad", b"ok")}
    keys = np.array([hashed[b"bad"][1], hashed[b"bad"][3], hashed[b"ok"][0]], np.uint64)
    order = np.argsort(keys)
    model = toxicity.Model(keys[order], np.array([2.0, 5.0, -1.0])[order])
    assert model.weigh([b"bad", b"bath", b"b", b"okay"]).tolist() == [5.0, 2.0, 0.0, -1.0]
    one, two, long = model.evidence([[b"bad", b"bath", b"b", b"okay"], [], [b"ok"] * 100_000 + [b"bad"]])
    assert one == pytest.approx([np.log(5), np.log(1 + 400 / 24), 7 / 3, 6 / 4]) and not two.any()
    assert long[1] == pytest.approx(np.log1p(350 / 100_021)) and long[2] == pytest.approx(1.0)


@pytest.mark.parametrize("shift", [(0, 0, 0, 0), (3, -1, 4, 0), (-6, 5, 8, -3), (0.5, 12, -7, 9)])
@pytest.mark.parametrize("scale", [0.3, 1, 4])
def test_the_curve_settles_wherever_the_evidence_lies(shift, scale):
    rng = np.random.default_rng(1)
    toxic = (np.arange(2400) % 2).astype(float)
    evidence = rng.normal(0, [0.9, 0.4, 1.1, 0.2], (2400, 4)) + np.outer(toxic, [2.6, 2.2, 6.9, 0.2])
    weight = np.where(toxic == 1, 0.2, 1.8)
    moved = scale * evidence + np.array(shift)
    w = toxicity.curve(moved, toxic, weight)
    score = 1 / (1 + np.exp(-np.clip(w[0] + moved @ w[1:], -30, 30)))
    assert (score[toxic == 1] >= toxicity.THRESHOLD).mean() >= 0.98
    assert (score[toxic == 0] < toxicity.THRESHOLD).mean() >= 0.98
    x = np.column_stack([np.ones(len(moved)), moved])
    slope = x.T @ (weight * (toxic - 1 / (1 + np.exp(-x @ w)))) - 1e-2 * w * (np.arange(5) > 0)
    assert np.abs(slope).max() < 1e-4

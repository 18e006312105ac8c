import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeframe.llm import lm_score
from tradeframe.llm.queries import vocabulary_path

WINDOW = lm_score.CONTEXT + lm_score.STRIDE
PATH = vocabulary_path("byte_bpe_50k.tiktoken")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base(rows):
    split = [(i, [*(t or "").encode().translate(lm_score.LOWER).split(), b""]) for i, t in rows]
    c = Counter(w for i, words in split if not held(i) for w in words)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in split]


def check(frame, rows, **settings):
    found = lm_score.scored(frame, PATH, **settings).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for got, want in zip(sorted(found, key=key), sorted(base(rows), key=key), strict=True):
        assert tuple(got)[:5] == want[:5] and got["base_score"] == pytest.approx(want[5])
        assert got["score"] < 0 and math.isfinite(got["score"]) and math.isfinite(got["attention_score"])
    return found


def test_counts_of_the_sample(sample):
    check(sample, [(r["doc_id"], r["text"]) for r in sample.collect()], block=30_000)


def test_odd_rows(odd_docs, no_docs, texts):
    found = check(odd_docs, texts)
    same = {r["score"] for r in found if r["n_tokens"] == 1}
    assert len(same) == 1  # null, empty and blank texts: one end
    assert lm_score.scored(no_docs, PATH).count() == 0


def test_more_text_beats_the_base(spark):
    """With a corpus to learn from, held-out texts are likelier than by smoothed counts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = lm_score.scored(docs, PATH).toPandas()
    known = found[~found.held_out]
    assert known.score.sum() > known.base_score.sum()
    out = found[found.held_out]
    assert out.score.sum() / out.n_tokens.sum() > out.base_score.sum() / out.n_tokens.sum()
    print(out.score.sum() / out.n_tokens.sum(), out.base_score.sum() / out.n_tokens.sum())


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    size = 400
    total = rng.integers(0, 1000, size)
    begins = rng.random(size) < 0.4
    begins[-1] = True
    return lm_score.classed(total, begins, rng.integers(0, size, (500, WINDOW)).astype(np.int32)).start()


def test_windows_score_each_id_once():
    counts = np.array([0, 5, 16, 40, 15, 47, 48, 49, 130])
    ids = np.arange(1, counts.sum() + 1, dtype=np.int32)
    windows, wanted = lm_score.laid_out(ids, counts, -7)
    targets = windows[:, lm_score.CONTEXT :].ravel()[wanted]
    want, at = [], 0
    for n in counts:
        want += [*ids[at : at + n], -7]
        at += n
    assert targets.tolist() == want and len(set(wanted.tolist())) == len(wanted)


def sides(model, ids):
    targets = ids[:, lm_score.CONTEXT :]
    return model.place[ids[:, :-1]], model.side[targets], model.group[targets]


def test_probabilities_sum_to_one(model):
    rows = np.random.default_rng(1).integers(0, 400, (1, WINDOW - 1))
    windows = np.concatenate([np.repeat(rows, 400, axis=0), np.arange(400)[:, None]], axis=1).astype(np.int32)
    chosen, start = (x.reshape(400, -1)[:, -1] for x in lm_score.predicted(model, windows))
    assert np.exp(chosen).sum() == pytest.approx(1, abs=1e-3)
    assert np.exp(chosen[model.side == 1]).sum() == pytest.approx(np.exp(start[0]), abs=1e-3)


def test_prediction_is_the_forward_pass(model):
    ids = np.random.default_rng(6).integers(0, 400, (5, WINDOW)).astype(np.int32)
    rows, side, group = sides(model, ids)
    u = lm_score.forward(model.w, rows)[-1]
    sure = 1 / (1 + np.exp(-(u @ model.w["S"] + model.w["bS"])))
    p = np.take_along_axis(np.where(side[..., None] == 1, *(lm_score.softmax(u @ model.w["U"][i] + model.w["bU"][i]) for i in (1, 0))), group[..., None], -1)[..., 0]
    chosen, start = lm_score.predicted(model, ids, batch=2)
    assert np.allclose(chosen, (np.log(np.where(side == 1, sure, 1 - sure) * p) + model.share[ids[:, lm_score.CONTEXT :]]).ravel(), atol=1e-4)
    assert np.allclose(start, np.log(sure).ravel(), atol=1e-4)


def test_later_ids_change_nothing_before(model):
    a = np.random.default_rng(2).integers(0, 400, (3, WINDOW)).astype(np.int32)
    b = a.copy()
    b[:, -4:] = 5
    p, q = (lm_score.forward(model.w, model.place[x[:, :-1]])[-1] for x in (a, b))
    assert np.allclose(p[:, :-3], q[:, :-3], atol=1e-6) and not np.allclose(p[:, -1], q[:, -1])


def test_gradients(model):
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rows, side, target = sides(model, np.random.default_rng(3).integers(0, 400, (4, WINDOW)))
    g, _ = lm_score.gradients(w, rows, side, target)
    rng = np.random.default_rng(4)
    for k in w:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in w[k].shape) if k != "E" else (int(rows[0, 3]), 2)
            losses = []
            for step in (1e-4, -1e-4):
                w[k][at] += step
                losses.append(lm_score.gradients(w, rows, side, target)[1])
                w[k][at] -= step
            assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, abs=1e-4), k


def plain_forward(w, rows):
    """Attention as it is defined, a place at a time: keys and values of all ids before it, a softmax, the layers behind it."""
    out = np.empty((len(rows), lm_score.STRIDE, w["E"].shape[1]))
    for i, window in enumerate(rows):
        x = w["E"][window]
        for p in range(lm_score.STRIDE):
            own, before = x[lm_score.CONTEXT - 1 + p], x[: lm_score.CONTEXT + p]
            a = (before @ w["K"]) @ (own @ w["Q"]) * float(lm_score.SCALE) + w["P"][p, : len(before)]
            z = own + lm_score.softmax(a) @ (before @ w["V"]) @ w["O"]
            out[i, p] = z + np.maximum(z @ w["W1"] + w["b1"], 0) @ w["W2"]
    return out


@pytest.mark.parametrize("scale", [1, 12])
def test_attention_as_defined(model, scale):
    """Also where exp of the logits would leave the range of single precision: nothing is cut off there."""
    ids = np.random.default_rng(8).integers(0, 400, (3, WINDOW)).astype(np.int32)
    rows, side, group = sides(model, ids)
    w = {k: v * np.float32(scale if k in ("E", "U", "P") else 1) for k, v in model.w.items()}
    w["P"] = w["P"] + np.float32(scale - 1)
    wide = {k: v.astype(np.float64) for k, v in w.items()}
    u = plain_forward(wide, rows)
    assert np.allclose(lm_score.forward(w, rows)[-1].reshape(u.shape), u, rtol=1e-3, atol=1e-3 * scale)
    logits = np.where(side[..., None] == 1, *(u @ wide["U"][i] + wide["bU"][i] for i in (1, 0)))
    if scale > 1:
        assert logits.max() > 90
    start = u @ wide["S"] + wide["bS"]
    want = np.take_along_axis(np.log(lm_score.softmax(logits) + 1e-300), group[..., None], -1)[..., 0] - np.logaddexp(0, np.where(side == 1, -start, start))
    fixed = lm_score.Model(model.place, model.side, model.group, model.share, w)
    chosen, starts = lm_score.predicted(fixed, ids)
    assert np.allclose(chosen, (want + model.share[ids[:, lm_score.CONTEXT :]]).ravel(), rtol=1e-3, atol=2e-2 * scale)
    assert np.allclose(starts, np.maximum(-np.logaddexp(0, -start).ravel(), -60), rtol=1e-3, atol=2e-2 * scale)


def test_gradients_in_pieces(model):
    """Those of a batch are the mean of each window's, whatever the pieces, and a step holds the arrays of one piece at a time."""
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    args = sides(model, np.random.default_rng(9).integers(0, 400, (2 * lm_score.PIECE + 3, WINDOW)))
    g, loss = lm_score.gradients(w, *args)
    each = [lm_score.gradients(w, *(x[i : i + 1] for x in args)) for i in range(len(args[0]))]
    assert loss == pytest.approx(np.mean([one for _, one in each]))
    for k in w:
        assert np.allclose(g[k], np.mean([one[k] for one, _ in each], axis=0), atol=1e-9), k
    peaks = []
    for n in (64, 640):
        args = sides(model, np.random.default_rng(9).integers(0, 400, (n, WINDOW)))
        tracemalloc.start()
        lm_score.gradients(model.w, *args)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0], peaks


def test_steps_are_those_of_adam(model):
    """Three steps of the textbook's, in double precision, from the same gradients."""
    ids = np.random.default_rng(10).integers(0, 400, (150, WINDOW)).astype(np.int32)
    found, w = lm_score.fitted(model, ids, 1, 0.01, 4), {k: v.astype(np.float64) for k, v in model.w.items()}
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = np.random.default_rng(4).permutation(len(ids))
    for step in (1, 2, 3):
        g, _ = lm_score.gradients(w, *sides(model, ids[order[64 * (step - 1) : 64 * step]]))
        for k in w:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            w[k] -= 0.01 * (1 - 0.9 * step / 3) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    for k in w:
        assert np.abs(found[k] - w[k]).max() < 2e-3 and np.abs(found[k] - w[k]).mean() < 2e-5, k


def test_fitting_lowers_the_loss(model):
    rng = np.random.default_rng(5)
    ids = (rng.integers(0, 5, (600, 1)) + np.arange(WINDOW) % 7).astype(np.int32)
    before = lm_score.gradients(model.w, *sides(model, ids))[1]
    w = lm_score.fitted(model, ids, 6, 0.01, 1)
    assert lm_score.gradients(w, *sides(model, ids))[1] < 0.5 * before


def test_every_training_text_fits_the_weights(spark):
    """A corpus of a few dozen documents is learned from whole, and no window is drawn twice for the first fit."""
    rows = [(i, f"w{i % 5} and some words of text {i % 5} " * 30) for i in range(40)]
    docs = spark.createDataFrame([(i, t, held(i)) for i, t in rows], "doc_id long, text string, held_out boolean")
    with open(PATH, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    size = lm_score.size_of(vocabulary.value)
    texts = lm_score.training_texts(docs, vocabulary)
    assert texts.count() == sum(not held(i) for i, _ in rows)
    every = {w.tobytes() for w in lm_score.windows_of([bytes(r["ids"]) for r in texts.collect()], size)}
    drawn = lm_score.warm_windows(texts, size, 10_000)
    assert len(drawn) == len(every) and {w.tobytes() for w in drawn} == every
    assert len({w.tobytes() for w in lm_score.warm_windows(texts, size, 10)}) == 10


def test_nothing_of_the_model_comes_from_a_sample(spark, monkeypatch):
    """Clusters and weights of a corpus too large for the driver come from every window, each in one round."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50} of text{i}" for k in range(60)), False) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    with open(PATH, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    size = lm_score.size_of(vocabulary.value)
    texts = lm_score.training_texts(docs, vocabulary)
    every = lm_score.windows_of([bytes(r["ids"]) for r in texts.collect()], size)
    total = np.bincount(every[:, lm_score.CONTEXT :].ravel(), minlength=size)
    slot = lm_score.slots(total)
    plain = np.zeros((size, lm_score.SIGNS), np.int64)
    for window in every:
        for i in window:
            np.add.at(plain[i], slot[window][slot[window] >= 0], 1)
    near = lm_score.all_neighbours(texts, slot)
    assert (near == plain).all() and (lm_score.neighbours(every, slot) == plain).all()
    edges = [0.0, *(high for _, high in lm_score.ROUNDS)]
    dealt = np.concatenate([lm_score.in_round(every, low, high) for low, high in zip(edges, edges[1:])])
    assert edges[-1] == 1.0 and sorted(w.tobytes() for w in dealt) == sorted(w.tobytes() for w in every)

    def sample(*_):
        raise AssertionError("a sample is drawn")

    monkeypatch.setattr(lm_score, "warm_windows", sample)
    monkeypatch.setattr(lm_score, "WARM", 10)
    counts = spark.createDataFrame([(b"of", 60)], "word binary, n long")
    model = lm_score.trained(docs, counts, vocabulary)
    sizes = lambda w: lm_score.gradients(w, *sides(model, every))[1]
    assert sizes(model.w) < sizes(lm_score.classed(total, model.side == 1, None, near).start().w)


def test_the_attention_model_is_the_score_and_beats_the_base(spark):
    """Held-out texts, in which each word follows from the one before, are likelier than by counts of words."""
    words = "red blue green house tree river stone cloud paper light".split()
    rows = [(i, " ".join(words[(i + k) % 10] for k in range(40 + i % 7))) for i in range(3000)]
    found = lm_score.scored(spark.createDataFrame(rows, "doc_id long, text string"), PATH).toPandas()
    assert (found.score == found.attention_score).all()
    out = found[found.held_out]
    assert len(out) and out.score.sum() > out.base_score.sum()


def plain_score(model, text, content):
    """The log10 probability of a text, one id at a time, by the forward pass alone."""
    end, made = lm_score.size_of(content) - 1, lm_score.encoder(content)[0]
    words = [made.encode_ordinary(" " + w.decode()) for w in (text or "").encode().translate(lm_score.LOWER).split()]
    line = [i for w in words for i in w] + [end]
    stream = [end] * lm_score.CONTEXT + line + [end] * lm_score.STRIDE
    chosen, start = [], []
    for p, target in enumerate(line):
        at = p // lm_score.STRIDE * lm_score.STRIDE
        window = np.array([stream[at : at + WINDOW - 1]])
        u = lm_score.forward(model.w, model.place[window])[-1][0, p - at]
        sure = 1 / (1 + math.exp(-float(u @ model.w["S"] + model.w["bS"][0])))
        side = int(model.side[target])
        share = lm_score.softmax(u @ model.w["U"][side] + model.w["bU"][side])[model.group[target]]
        chosen.append(math.log((sure if side else 1 - sure) * share) + model.share[target])
        start.append(math.log(sure))
    total, at = 0.0, 0
    for w in words:  # a word, given that one starts, and that it is over
        total += sum(chosen[at : at + len(w)]) - start[at] + start[at + len(w)]
        at += len(w)
    return (total + chosen[at] - start[at]) / math.log(10)


def test_scores_of_whole_texts_by_the_forward_pass(spark, monkeypatch):
    with open(PATH, "rb") as file:
        content = file.read()
    rng, size = np.random.default_rng(7), lm_score.size_of(content)
    fixed = lm_score.classed(rng.integers(0, 1000, size), lm_score.starts_word(content), rng.integers(0, size, (200, WINDOW)).astype(np.int32)).start()
    monkeypatch.setattr(lm_score, "trained", lambda *_: fixed)
    rows = [(1, "The cat sat on the mat"), (2, None), (3, "a" * 40), (4, " ".join(f"word{i} of" for i in range(60))), (5, "Ünï 日本 x"), (6, "very " * 30_000)]
    found = {r["doc_id"]: r["score"] for r in lm_score.scored(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    for i, text in rows[:-1]:
        assert found[i] == pytest.approx(plain_score(fixed, text, content), rel=1e-4, abs=1e-3), i
    assert math.isfinite(found[6]) and found[6] < found[4]  # a very long text


def test_texts_are_dealt_once(spark, monkeypatch):
    """A partition has one worker's texts, a block is in one partition, and no round of fitting shuffles texts again."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50} of text{i}" for k in range(60)), held(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    with open(PATH, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    monkeypatch.setattr(lm_score, "PER_WORKER", 8_000)
    found = lm_score.dealt(docs, vocabulary, 2_000).withColumn("partition", F.spark_partition_id()).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(60))
    workers, blocks = {}, {}
    for r in found:
        workers.setdefault(r["partition"], set()).add(r["worker"])
        blocks.setdefault(r["block"], set()).add(r["partition"])
    assert len(workers) > 3 and all(len(w) == 1 for w in workers.values()) and all(len(p) == 1 for p in blocks.values())
    texts = lm_score.cut(lm_score.dealt(docs, vocabulary, 2_000).select("worker", "ids"))
    size = lm_score.size_of(vocabulary.value)
    model = lm_score.classed(np.ones(size), lm_score.starts_word(vocabulary.value), lm_score.windows_of([bytes(r["ids"]) for r in texts.collect()], size)).start()

    def again(*_):
        raise AssertionError("texts are shuffled")

    monkeypatch.setattr(type(texts), "repartition", again)
    monkeypatch.setattr(type(texts), "groupBy", again)
    w = lm_score.averaged(texts, 1 + max(r["worker"] for r in found), spark.sparkContext.broadcast(model), 0.01)
    assert all(np.isfinite(x).all() for x in w.values()) and (w["Q"] != model.w["Q"]).any()


def test_words_from_ids():
    """Words, their order and their numbers come back from the ids, whatever the texts' order."""
    with open(PATH, "rb") as file:
        content = file.read()
    texts = ["The cat sat on the mat", None, "", "a\u3000b \u3000c A the", "x" * 300 + " y the", "Ünïcödé  日本語 <|endoftext|> 'll"]
    kind = lm_score.id_type(lm_score.size_of(content))
    both = []
    for some in (texts, texts[::-1]):
        ids, size, per_text = lm_score.Texts(some).subwords(content)
        found = lm_score.Encoded([x.astype(kind).tobytes() for x in np.split(ids, np.cumsum(per_text)[:-1])], content)
        words = [(t or "").encode().translate(lm_score.LOWER).split() for t in some]
        different = found.words()
        assert [different[i] for i in found.code] == [w for line in words for w in line]
        assert found.count.tolist() == list(map(len, words)) and found.size.tolist() == size.tolist()
        both.append(different)
    assert both[0] == both[1] and len(set(both[0])) == found.kinds

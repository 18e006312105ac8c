"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary texts, spell a word letter by letter, from the word's
beginning so far (up to ``DEPTH`` bytes). Both take the counts of their class as they are, give up an
absolute ``DISCOUNT`` of each, and hand what is given up to one shared level: in how many different
texts, of either class, a beginning goes on so. So a rare word backs off to its stem and a
beginning that one class never had is spelled alike by both: it weighs what its known part
weighs, and a stem whose endings are ever others has the count of all of them.

A word's evidence is the difference of its two log-likelihoods. A text's evidence, normalised by its
length, is the sum of what its words have beyond ``STRONG`` for every hundred words (so that several
marked words in a short text are more than one in a long text), that sum itself, the ``TOP``
strongest words, and the mean over all words; a logistic curve over these makes the score. Models are
fitted on at most ``SAMPLE`` labelled rows of each class (chosen by hash), the curve on other rows of the
same sample. All texts are scored, whole.

Rows: a null or empty text has no evidence and gets the score of zero evidence. Nulls in
``doc_id`` and repeated rows pass through (a null ``doc_id`` is not held out and has no label); if
labels disagree about a document, toxic wins; null labels are ignored. Without labels of both
classes every score is 0. Only ``doc_id`` and ``text``, ``doc_id`` and ``toxic`` are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.common import extended, few, in_fold, kept, slices

#: Most labelled rows of each class; four fifths are for the models, the rest for the curve.
SAMPLE = 6_000
#: Bytes of a word that are spelled, its end included; a longer word counts as its beginning.
DEPTH = 20
DISCOUNT = 0.75
STRONG = 1.5
TOP = 3
#: Added to a text's number of words where evidence is taken for every hundred.
LEAST_WORDS = 20
THRESHOLD = 0.3
#: Words whose evidence a worker remembers.
REMEMBERED = 200_000
EVIDENCE = ("sum", "share", "top", "mean")

#: Bytes that are no part of a word; letters beyond ASCII are.
GAPS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(GAPS).split()


def spelled(some: list[bytes]) -> np.ndarray:
    """A row of ``DEPTH`` bytes for each word; a zero ends it."""
    return np.array(some or [b""], f"S{DEPTH}").view(np.uint8).reshape(-1, DEPTH)[: len(some)]


def hashes(letters: np.ndarray) -> Iterator[np.ndarray]:
    """For every length from 1 the hash of each word's beginning of that length."""
    now = np.zeros(len(letters), np.uint64)
    for column in letters.T:
        now = (now + column.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        now ^= now >> np.uint64(29)
        yield now


@dataclass
class Model:
    """``weight`` of each beginning (by hash, sorted): the difference of its two log-likelihoods.
    A beginning that only goes on one way is left out: its only way weighs the same."""

    keys: np.ndarray
    weight: np.ndarray
    known: dict[bytes, float] = field(default_factory=dict)

    def weigh(self, some: list[bytes]) -> np.ndarray:
        """The weight of the longest known beginning of each word."""
        out = np.zeros(len(some))
        if len(self.keys):
            for key in hashes(spelled(some)):
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                out = np.where(self.keys[at] == key, self.weight[at], out)
        return out

    def evidence(self, texts: list[list[bytes]]) -> np.ndarray:
        """The columns ``EVIDENCE`` of each text."""
        flat = [w for text in texts for w in text]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := list(set(flat) - self.known.keys()):
            self.known.update(zip(new, self.weigh(new).tolist()))
        each = np.fromiter(map(self.known.__getitem__, flat), float, len(flat))
        found = np.zeros((len(texts), len(EVIDENCE)))
        at = 0
        for i, n in enumerate(map(len, texts)):
            if n:
                part = each[at : at + n]
                total = np.maximum(part - STRONG, 0).sum()
                top = part if n <= TOP else np.partition(part, n - TOP)[-TOP:]
                found[i] = np.log1p(total), np.log1p(100 * total / (n + LEAST_WORDS)), top.sum() / TOP, np.clip(part, -3, 6).mean()
                at += n
        return found


def known_labels(labels: DataFrame) -> DataFrame:
    """One label per document outside the held-out fold; the others are never looked at."""
    return (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2))
            .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows of each class: ``doc_id``, ``toxic``, ``text``."""
    known = known_labels(labels)
    some = [few(known.filter(F.col("toxic") == c), sample, "doc_id") for c in (1, 0)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 * sample rows of two numbers at most
    return (docs.select("doc_id", "text").join(chosen, "doc_id")
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))


def word_counts(rows: DataFrame) -> DataFrame:
    """``word`` (its first ``DEPTH`` bytes), how often it occurs in each class, and in how many texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            count: tuple[Counter, Counter] = (Counter(), Counter())
            texts: Counter = Counter()
            for toxic, text in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist()):
                line = [w[:DEPTH] for w in words(text)]
                count[toxic].update(line)
                texts.update(set(line))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(texts), pa.binary()), *(pa.array([c[w] for w in texts], pa.int64()) for c in count[::-1]), pa.array(list(texts.values()), pa.int64())],
                names=["word", "toxic", "ordinary", "texts"])

    found = rows.select("toxic", "text").mapInArrow(work, "word binary, toxic long, ordinary long, texts long")
    return found.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("toxic", "ordinary", "texts")))


def fit(rows: DataFrame) -> Model:
    """The model of labelled rows. What reaches the driver is a row per different word of the sample."""
    found = word_counts(rows).toArrow().sort_by("word")
    return learned(found.column("word").to_pylist(), np.array([found.column(c).to_numpy() for c in ("toxic", "ordinary", "texts")], float))


def learned(some: list[bytes], count: np.ndarray) -> Model:
    """From different words in order, with rows of their counts: toxic, ordinary, texts."""
    letters = spelled(some)
    n = len(some)
    if not n:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    # a beginning is a run of words; at first all words are one run
    starts, of_word, total = np.zeros(1, np.int64), np.zeros(n, np.int64), count.sum(axis=1, keepdims=True)
    weight = np.zeros(1)
    begins = np.zeros(n, bool)
    begins[0] = True
    keys, weights = [], []
    for depth, key in enumerate(hashes(letters)):
        begins = begins.copy()
        begins[1:] |= letters[1:, depth] != letters[:-1, depth]
        parent = of_word
        starts, of_word = np.flatnonzero(begins), np.cumsum(begins) - 1
        above = parent[starts]
        here = np.add.reduceat(count, starts, axis=1)
        ways = np.array([np.bincount(above, x > 0, len(weight)) for x in here[:2]])
        texts = np.bincount(above, here[2], len(weight))
        shared = here[2] / texts[above]
        given_up = DISCOUNT * ways[:, above] * shared
        chance = np.where(total[:2, above] > 0, (np.maximum(here[:2] - DISCOUNT, 0) + given_up) / np.maximum(total[:2, above], 1), shared)
        weight = weight[above] + np.log(chance[0]) - np.log(chance[1])
        several = np.bincount(above)[above] > 1
        keys.append(key[starts[several]])
        weights.append(weight[several])
        total = here
    every = np.concatenate(keys)
    order = np.argsort(every)
    return Model(every[order], np.concatenate(weights)[order])


def curve(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve (a constant and the columns ``EVIDENCE``), by Newton steps on the penalised
    loss. It is convex, and a step is halved until it lowers it: so the steps settle wherever the evidence lies."""
    middle = evidence.mean(axis=0)
    x = np.column_stack([np.ones(len(evidence)), evidence - middle])
    w, ridge = np.zeros(x.shape[1]), np.array([0.0, *[1e-2] * evidence.shape[1]])

    def loss(w: np.ndarray) -> float:
        line = x @ w
        return (weight * (np.logaddexp(0, line) - toxic * line)).sum() + (ridge * w**2).sum() / 2

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weight * (toxic - p)) - ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(bend, slope)
        gain = slope @ step
        if gain < 1e-9:  # less than the loss can tell
            w = w + step
            break
        while gain > 1e-12 and loss(w + step) > now - 1e-4 * gain:
            step, gain = step / 2, gain / 2
        w = w + step
        now = loss(w)
    return np.r_[w[0] - middle @ w[1:], w[1:]]


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every document."""
    return scored(docs, labels, ("doc_id",), sample).select(
        "doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], sample: int = SAMPLE) -> DataFrame:
    """The columns ``keep`` of every document, and ``score``."""
    rows = kept(labelled(docs, labels, sample), "toxicity-sample")
    for_curve = F.xxhash64(F.lit("curve"), "doc_id") % 5 == 0
    spark = docs.sparkSession
    wide = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return wide.select(*keep, F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(fit(rows.filter(~for_curve)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = shared.value.evidence([words(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *map(pa.array, found.T)], names=["toxic", *EVIDENCE])

    fitted: pd.DataFrame = rows.filter(for_curve).select("toxic", "text").mapInArrow(measure, "toxic int, " + ", ".join(f"{c} double" for c in EVIDENCE)).toArrow().to_pandas()
    share = known_labels(labels).agg(F.avg("toxic")).first()[0]
    toxic = fitted["toxic"].to_numpy(float)
    if len(set(toxic)) < 2:  # too few rows for a curve
        toxic, fitted = np.array([1.0, 0.0]), pd.DataFrame([(1.0, 1.0, 2.0, 0.1), (0.0, 0.0, 0.0, 0.0)], columns=EVIDENCE)
    weight = np.where(toxic == 1, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    w = curve(fitted[list(EVIDENCE)].to_numpy(), toxic, weight)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = shared.value.evidence([words(t) for t in part.column("text").to_pylist()])
            line = np.clip(w[0] + found @ w[1:], -30, 30)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(1 / (1 + np.exp(-line)))], names=[*keep, "score"])

    return wide.mapInArrow(score, extended(wide.select(*keep).schema, "score double"))

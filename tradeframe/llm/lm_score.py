"""Log-probabilities of texts by a causal self-attention model over subwords.

A text is its words in lower case and one end. Each word is a row of subword ids of a public
byte-pair vocabulary, the first of which holds the space before it. The model reads windows of
``CONTEXT`` + ``STRIDE`` ids; windows overlap by ``CONTEXT``, and each scores only its last ``STRIDE`` ids, so every
id is scored once, with at least ``CONTEXT`` ids before it. All windows of a block of documents go
through masked attention in batches. The output is a class of subwords, the frequent ones alone and the
others in clusters, times the subword's share of its class in the corpus. The chance that a word
ends is the chance that the next subword starts a word.

What is gathered from the corpus: the counts of all words of all training texts (and from them
of all subwords); what stands near each subword in all windows, which decides what cluster a rare one is
in; the weights, fitted on all training texts, whole. Many workers fit at once, each on its own texts,
and their weights are averaged in a tree. The windows are dealt to ``ROUNDS``, each window to one, and each
round goes on from the last one's average, so that workers part little while the weights are new. Where all
windows are at most ``WARM``, the driver takes three passes over all of them first. Nothing is sampled.

Score: ``score`` and ``attention_score`` are the attention model's log-probability and nothing else;
of word counts it has only the subwords' shares of their classes. ``base_score`` are the corpus's word
counts, smoothed by one, to compare with.

Texts are encoded once, dealt once to blocks and workers and kept as ids, from which words, windows and scores are
made. The counts a block of documents needs are asked for once per different word, joined by word, and
returned to the block. Nothing that grows with the input is broadcast or collected.

Rows: a null or empty text has one token, the end. A null ``doc_id`` is training data; repeated rows
count each time and are scored each. Only ``doc_id`` and ``text`` are read. Without training texts
all counts are 0 and the attention model has its starting weights.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.common import extended, in_fold, kept, part_count, slices
from tradeframe.llm.substring_dedup import Words, mixed
from tradeframe.session import cut

CONTEXT, STRIDE = 16, 48
WIDTH, HIDDEN = 32, 64
#: Classes of one side (subwords that start a word, or go on with it), and how many of them are one subword.
SIDE = 160
ALONE = 112
#: Subwords that the clusters are made by.
SIGNS = 64
#: Subwords with an embedding of their own; the others share ``POOL``.
OWN, POOL = 8_000, 192
#: Most windows of a corpus so small that the driver fits on all of it first.
WARM = 12_000
#: Learning rates of the rounds in which workers fit the weights, and how much of all windows each round ends at.
ROUNDS = ((0.01, 1 / 16), (0.01, 1 / 8), (0.01, 1 / 4), (0.01, 1 / 2), (0.01, 1.0))
#: A corpus of fewer windows than this is passed over more than once, at most ``PASSES`` times.
MANY, PASSES = 100_000, 4
#: The only round of a small corpus, whose weights are warm.
ONE_ROUND = ((0.01, 1.0),)
#: Characters of the texts of one worker, about; and how many weights one task averages at most, its own workers' or others'.
PER_WORKER = 5_000_000
FAN = 32
BLOCK = 5_000_000
#: Bytes of text that are split at once.
PART = 1_000_000
#: Windows whose gradients are taken at once, and weights that are changed at once: what a core's cache holds.
PIECE, STRETCH = 16, 1 << 15
END = b""

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


_encoders: dict[int, object] = {}
#: Blanks that are part of a word here but not for the vocabulary's pattern.
INNER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def encoder(content: bytes):
    import tiktoken
    from public_tokenizers import PATTERN

    if (key := hash(content)) not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _encoders[key] = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), starts_word(content)
    return _encoders[key]


def subwords(words: list[bytes], content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, each with a space before it, and the number of ids of each."""
    made, begins = encoder(content)
    line = b" ".join([b"", *words]).decode()
    if not words or not INNER_BLANK.search(line):  # every space begins a word, and a piece
        ids = np.array(made.encode_ordinary(line), np.int32)
        at = np.flatnonzero(begins[ids])
        return ids, np.diff(np.r_[at, len(ids)])
    each = [made.encode_ordinary(" " + w.decode()) for w in words]
    return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)


def size_of(content: bytes) -> int:
    """Number of ids, the end included, which is the last."""
    return content.count(b"\n") + (not content.endswith(b"\n")) + 1


def starts_word(content: bytes) -> np.ndarray:
    begins = np.zeros(size_of(content), bool)
    for a, b in map(bytes.split, content.splitlines()):
        begins[int(b)] = base64.b64decode(a)[:1] == b" "
    begins[-1] = True
    return begins


@dataclass
class Model:
    """``place``: the embedding of each id; ``side``: 1 if it starts a word; ``group``: its class on
    that side; ``share``: log of its share there; ``w``: the weights by name."""

    place: np.ndarray
    side: np.ndarray
    group: np.ndarray
    share: np.ndarray
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        def some(*shape: int, scale: float = 0.0) -> np.ndarray:
            return (rng.standard_normal(shape) * (scale or shape[-2] ** -0.5)).astype(np.float32)
        d = WIDTH
        self.w = {"E": some(OWN + POOL, d, scale=0.3), "P": np.zeros((STRIDE, CONTEXT + STRIDE - 1), np.float32), "Q": some(d, d), "K": some(d, d),
                  "V": some(d, d), "O": some(d, d), "W1": some(d, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "W2": some(HIDDEN, d),
                  "U": some(2, d, SIDE), "bU": np.zeros((2, SIDE), np.float32), "S": some(d, 1)[:, 0], "bS": np.zeros(1, np.float32)}
        for i in (0, 1):  # a class without subwords takes nothing from the others
            self.w["bU"][i, np.bincount(self.group[self.side == i], minlength=SIDE) == 0] = -1e4
        return self


#: Which of a window's ids each of the last ``STRIDE`` places may look at.
MASK = np.where(np.arange(CONTEXT + STRIDE - 1)[None, :] <= np.arange(STRIDE)[:, None] + CONTEXT - 1, 0.0, -1e9).astype(np.float32)
SCALE = np.float32(WIDTH**-0.5)


def softmax(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``."""
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def exponents(logits: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A softmax before its division, which costs less where the rows are narrower: exp of each logit, the sums along the last
    axis, and what was taken from the logits (0, or where exp leaves the range, for which they are made again, each row's greatest)."""
    e = logits()
    ones = np.ones(e.shape[-1], e.dtype)
    with np.errstate(over="ignore"):
        total = np.exp(e, out=e) @ ones
    if total.min(initial=1) > 1e-20 and total.max(initial=1) < 1e20:
        return e, total, np.zeros_like(total)
    e = logits()
    highest = e.max(axis=-1)
    e -= highest[..., None]
    return e, np.exp(e, out=e) @ ones, highest


def keep_freed() -> None:
    """Lets this process keep the memory of freed arrays (glibc keeps what is smaller than the largest array freed so
    far); else each of the many short-lived ones is new memory, which costs a tenth to a sixth of the time."""
    np.empty(24 << 20, np.uint8)


def with_one(x: np.ndarray) -> np.ndarray:
    """Each row with a 1 behind it, by which a matrix has its bias as the last row."""
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)


def forward(w: dict[str, np.ndarray], rows: np.ndarray) -> tuple:
    """All but the last id of each window attend to what is before them; what the last ``STRIDE`` of
    these know about the next id is ``u``. In all but it places are one after the other, a row each. Keys and values are never made: what a
    place asks is multiplied by ``Q K'``, and the mean of what it finds by ``V O``."""
    d = w["E"].shape[1]
    x = np.take(w["E"], rows, axis=0)
    across = np.ascontiguousarray(x.transpose(0, 2, 1))
    own = x[:, CONTEXT - 1 :].reshape(-1, d)
    t = own @ (w["Q"] @ w["K"].T * SCALE)
    bias = w["P"] + MASK

    def logits() -> np.ndarray:
        a = t.reshape(len(x), -1, d) @ across
        a += bias
        return a

    a, total, _ = exponents(logits)
    total = total.reshape(-1, 1)
    c = (a @ x).reshape(-1, d)
    c /= total
    z = c @ (w["V"] @ w["O"])
    z += own
    z = with_one(z)
    r = z @ np.concatenate([w["W1"], w["b1"][None]])
    np.maximum(r, np.zeros_like(r), out=r)
    u = r @ w["W2"]
    u += z[:, :-1]
    return x, across, own, t, a, total, c, z, r, u.reshape(len(x), -1, d)


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, side: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Those of the mean loss of all windows, summed over ``PIECE`` of them at a time, as much as fits a core's cache."""
    n, d = target.size, w["E"].shape[1]
    g, loss = {k: np.zeros_like(v) for k, v in w.items()}, 0.0
    asks, gives = w["Q"] @ w["K"].T * SCALE, w["V"] @ w["O"]
    classes, inner = np.concatenate([w["U"], w["bU"][:, None]], axis=1), np.concatenate([w["W1"], w["b1"][None]])
    g_asks, g_gives, g_classes, g_inner = map(np.zeros_like, (asks, gives, classes, inner))
    pairs = np.dtype(f"c{2 * w['E'].itemsize}")  # two numbers at once, as one complex number
    for i in range(0, len(rows), PIECE):
        x, across, own, t, a, total, c, z, r, u = forward(w, rows[i : i + PIECE])
        shape, u = u.shape, u.reshape(-1, d)
        # ids that go on with a word first, then those that start one
        order = np.argsort(side[i : i + PIECE], axis=None, kind="stable")
        aim, middle = target[i : i + PIECE].ravel()[order], len(order) - int(side[i : i + PIECE].sum())
        known = with_one(u[order])
        sure = 1 / (1 + np.exp(-(known[:, :-1] @ w["S"] + w["bS"])))
        loss -= np.log(1 - sure[:middle] + 1e-9).sum() + np.log(sure[middle:] + 1e-9).sum()
        sure[middle:] -= 1
        sure /= n
        g["S"] += sure @ known[:, :-1]
        g["bS"] += sure.sum()
        back = sure[:, None] * w["S"]
        for j, of in ((0, slice(0, middle)), (1, slice(middle, None))):
            p, sums, _ = exponents(lambda: known[of] @ classes[j])
            at = np.arange(len(p)), aim[of]
            loss -= np.log(p[at] / sums + 1e-9).sum()
            p[at] -= sums
            part = (1 / (sums * n))[:, None]
            g_classes[j] += (known[of] * part).T @ p
            back[of] += (p @ w["U"][j].T) * part
        du = np.empty_like(u)
        du[order] = back
        dr = du @ w["W2"].T
        dr *= r > 0
        g["W2"] += r.T @ du
        g_inner += z.T @ dr
        dz = du
        dz += dr @ w["W1"].T
        g_gives += c.T @ dz
        dc = dz @ gives.T
        dc /= total
        lost = np.einsum("ij,ij->i", dc, c)
        dc = dc.reshape(shape)
        da = dc @ across
        da -= lost.reshape(len(x), -1, 1)
        da *= a
        g["P"] += da.sum(0)
        dt = (da @ x).reshape(-1, d)
        g_asks += own.T @ dt
        dx = a.transpose(0, 2, 1) @ dc
        dx += da.transpose(0, 2, 1) @ t.reshape(shape)
        dz += dt @ asks.T
        dx[:, CONTEXT - 1 :] += dz.reshape(shape)
        at = (rows[i : i + PIECE].reshape(-1, 1) * (d // 2) + np.arange(d // 2)).ravel()
        np.add.at(g["E"].reshape(-1).view(pairs), at, dx.reshape(-1).view(pairs))
    g |= {"Q": g_asks @ w["K"] * SCALE, "K": g_asks.T @ w["Q"] * SCALE, "V": g_gives @ w["O"].T, "O": w["V"].T @ g_gives}
    g |= {"U": g_classes[:, :-1], "bU": g_classes[:, -1], "W1": g_inner[:-1], "b1": g_inner[-1]}
    return g, float(loss) / n


def fitted(model: Model, windows: np.ndarray, epochs: int, rate: float, seed: int, batch: int = 64) -> dict[str, np.ndarray]:
    """The weights after some passes over ``windows`` (a row of ids each), by Adam. Its two sums, ``m`` and ``s``, are not
    yet multiplied by 0.1 and 0.01, and all weights are one array, changed a stretch that a core's cache holds at a time."""
    flat = np.concatenate([v.ravel() for v in model.w.values()])
    edges = np.cumsum([v.size for v in model.w.values()])[:-1]
    w = {k: x.reshape(v.shape) for (k, v), x in zip(model.w.items(), np.split(flat, edges))}
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    keep_freed()
    rng, step = np.random.default_rng(seed), 0
    steps = max(1, epochs * -(-len(windows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            ids = windows[order[i : i + batch]]
            found, _ = gradients(w, model.place[ids[:, :-1]], model.side[ids[:, CONTEXT:]], model.group[ids[:, CONTEXT:]])
            g = np.concatenate([found[k].ravel() for k in w])
            step += 1
            now = rate * (1 - 0.9 * step / steps)
            root = ((1 - 0.99**step) / 0.01) ** 0.5
            for at in range(0, len(flat), STRETCH):
                of = slice(at, at + STRETCH)
                m[of] *= 0.9
                m[of] += g[of]
                s[of] *= 0.99
                g[of] *= g[of]
                s[of] += g[of]
                change = np.sqrt(s[of], out=g[of])
                change += 1e-6 * root
                np.divide(m[of], change, out=change)
                change *= now * root * 0.1 / (1 - 0.9**step)
                flat[of] -= change
    return w


def laid_out(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several texts (``counts`` ids each) as windows; and where, among all predictions
    of all windows, those of the texts' ids and ends are."""
    needed = -(-(counts + 1) // STRIDE) * STRIDE
    size = needed + CONTEXT
    first = np.cumsum(size) - size
    stream = np.full(int(size.sum()), end, np.int32)
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    stream[np.repeat(first + CONTEXT, counts) + inside] = ids
    each = needed // STRIDE
    begin = np.repeat(first, each) + STRIDE * (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each))
    windows = stream[begin[:, None] + np.arange(CONTEXT + STRIDE)]
    of_text = np.cumsum(needed) - needed
    length = counts + 1
    wanted = np.repeat(of_text, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return windows, wanted


def predicted(model: Model, windows: np.ndarray, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of every scored id, and that its place starts a word."""
    w = model.w
    share, classes = model.share.astype(np.float32), np.concatenate([w["U"], w["bU"][:, None]], axis=1)
    columns = np.ascontiguousarray(classes.transpose(0, 2, 1))
    keep_freed()
    chosen, start = np.empty((len(windows), STRIDE)), np.empty((len(windows), STRIDE))
    for i in range(0, len(windows), batch):
        ids = windows[i : i + batch]
        u = forward(w, np.take(model.place, ids[:, :-1]))[-1].reshape(-1, WIDTH)
        target = ids[:, CONTEXT:].ravel()
        side, group = np.take(model.side, target), np.take(model.group, target)
        s = u @ w["S"] + w["bS"]
        starts = -np.log1p(np.exp(np.minimum(-s, 60)))
        found = np.where(side == 1, starts, starts - s) + np.take(share, target)
        for j in (0, 1):
            of = np.flatnonzero(side == j)
            known = with_one(np.take(u, of, axis=0))
            _, total, highest = exponents(lambda: known @ classes[j])
            found[of] += np.einsum("ij,ij->i", known, np.take(columns[j], group[of], axis=0)) - highest - np.log(total)
        chosen[i : i + batch], start[i : i + batch] = found.reshape(-1, STRIDE), starts.reshape(-1, STRIDE)
    return chosen.ravel(), start.ravel()


class Texts:
    """Words of some texts, as numbers of different words (told apart by a 64-bit hash)."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode().translate(LOWER) for t in texts]
        parts, start, total = [], 0, 0
        for i, t in enumerate(raw):
            if i > start and total + len(t) > PART:
                parts.append(Words(raw[start:i]))
                start, total = i, 0
            total += len(t)
        parts.append(Words(raw[start:]))
        self.count = np.concatenate([p.count for p in parts])
        self.code, different = pd.factorize(np.concatenate([p.hash for p in parts]))
        edges = np.cumsum([0, *(len(p.hash) for p in parts)])
        at = np.empty(len(different), np.int64)
        at[self.code[::-1]] = np.arange(len(self.code))[::-1]  # the first place of each
        self.words: list[bytes] = []
        for i, p in enumerate(parts):
            line, mine = p.bytes(), at[(at >= edges[i]) & (at < edges[i + 1])] - edges[i]  # in order: numbers follow first places
            self.words += [line[a:b] for a, b in zip(p.start[mine].tolist(), p.stop[mine].tolist())]

    def subwords(self, content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of ids of each word, and of each text."""
        pool, size = subwords(self.words, content)
        at = np.cumsum(size) - size
        n = size[self.code]
        ids = pool[np.repeat(at[self.code], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        total = np.r_[0, np.cumsum(n)]
        edges = np.r_[0, np.cumsum(self.count)]
        return ids, n, total[edges[1:]] - total[edges[:-1]]


class Encoded:
    """Texts given by their ids (in bytes, see ``id_type``): the numbers of words and of ids of each text, and of each word its
    number of ids and its place among the ``kinds`` different words. These are told apart, and put in order, by a
    64-bit hash, so the same texts in another order number them alike."""

    def __init__(self, texts: list[bytes], content: bytes) -> None:
        kind = id_type(size_of(content))
        self.made, begins = encoder(content)
        self.ids = np.frombuffer(b"".join(texts), kind).astype(np.int32)
        self.ids_per_text = np.array([len(t) for t in texts], np.int64) // np.dtype(kind).itemsize
        at = np.flatnonzero(begins[self.ids])
        self.count = np.diff(np.searchsorted(at, np.r_[0, np.cumsum(self.ids_per_text)])).astype(np.int64)
        self.size = np.diff(np.r_[at, len(self.ids)])
        inside = np.arange(len(self.ids)) - np.repeat(at, self.size)
        up = np.cumprod(np.full(int(self.size.max(initial=0)) + 1, FACTORS[2]), dtype=np.uint64)
        term = mixed(self.ids.astype(np.uint64) + FACTORS[3]) * up[inside]
        different, first, self.code = np.unique(mixed(np.add.reduceat(term, at)) if len(at) else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        self.kinds, self.first = len(different), at[first]
        self.length = self.size[first]

    def words(self) -> list[bytes]:
        """The different words, in order."""
        return [self.made.decode_bytes(self.ids[a : a + n].tolist())[1:] for a, n in zip(self.first.tolist(), self.length.tolist())]


def block_words(rows: DataFrame, vocabulary) -> DataFrame:
    """The different words of each block, the end last, with their places and their number in its training texts. ``rows``
    are dealt: a block is in one task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        block = table.column("block").to_numpy()
        for number in np.unique(block):
            own = table.take(np.flatnonzero(block == number))
            texts = Encoded(own.column("ids").to_pylist(), vocabulary.value)
            train = ~own.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            n = np.r_[np.bincount(texts.code[np.repeat(train, texts.count)], minlength=texts.kinds), train.sum()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)),
                                              pa.array([*texts.words(), END], pa.binary()), pa.array(n)], names=["block", "at", "word", "n"])

    return rows.select("block", "held_out", "ids").mapInArrow(work, "block int, at int, word binary, n int")


def subword_counts(counts: DataFrame, vocabulary) -> np.ndarray:
    """How often each id occurs in the training texts (as many numbers as the vocabulary has)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size_of(vocabulary.value), np.int64)
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist())]
            total[-1] += sum(n for w, n in rows if not w)
            rows = [x for x in rows if x[0]]
            ids, size = subwords([w for w, _ in rows], vocabulary.value)
            np.add.at(total, ids, np.repeat([n for _, n in rows], size).astype(np.int64))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])

    rows = counts.mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    total = np.zeros(size_of(vocabulary.value), np.int64)
    total[rows["id"]] = rows["n"]
    return total


def dealt(docs: DataFrame, vocabulary, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``held_out``, ``block``, ``worker`` and ``ids`` (in bytes, see ``id_type``) of every text. Blocks have about
    ``block`` characters, and a worker as many blocks as it takes; a partition has one worker's texts, however long single ones are."""
    total = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks, each = total // block + 1, max(1, PER_WORKER // block)
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.select("doc_id", "held_out", number.alias("block"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(size_of(vocabulary.value))
        for part in slices(batches, "text"):
            ids, _, per_text = Texts(part.column("text").to_pylist()).subwords(vocabulary.value)
            texts = np.split(ids.astype(kind), np.cumsum(per_text)[:-1])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held_out", "block")), pa.array([x.tobytes() for x in texts], pa.binary())],
                                             names=["doc_id", "held_out", "block", "ids"])

    found = rows.mapInArrow(work, extended(rows.drop("text").schema, "ids binary")).withColumn("worker", F.floor(F.col("block") / each).cast("int"))
    return found.repartitionById((blocks - 1) // each + 1, "worker")


def training_texts(docs: DataFrame, vocabulary) -> DataFrame:
    """``worker`` and ``ids`` of every training text, dealt by worker."""
    return dealt(docs, vocabulary).filter(~F.col("held_out")).select("worker", "ids")


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.int32


def windows_of(texts: list[bytes], size: int) -> np.ndarray:
    """All windows of the texts that ``training_texts`` wrote; ``size`` is the number of ids."""
    kind = id_type(size)
    counts = np.array([len(t) for t in texts], np.int64) // np.dtype(kind).itemsize
    return laid_out(np.frombuffer(b"".join(texts), kind).astype(np.int32), counts, size - 1)[0]


FACTORS = np.random.default_rng(0).integers(1, 1 << 62, CONTEXT + STRIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def hashed(windows: np.ndarray) -> np.ndarray:
    """31 bits for each window."""
    mixed = np.zeros(len(windows), np.uint64)
    for i, factor in enumerate(FACTORS):
        mixed = (mixed ^ mixed >> np.uint64(29)) * factor + windows[:, i].astype(np.uint64) * FACTORS[0]
    return (mixed ^ mixed >> np.uint64(31)) * FACTORS[1] >> np.uint64(33)


def in_round(windows: np.ndarray, low: float, high: float) -> np.ndarray:
    """The windows of the round from ``low`` to ``high``; where a window is does not change it."""
    if (low, high) == (0.0, 1.0):
        return windows
    at = hashed(windows)
    return windows[(at >= int(low * (1 << 31))) & (at < int(high * (1 << 31)))]


def window_count(texts: DataFrame, size: int) -> int:
    return texts.select(F.sum(F.ceil((F.length("ids") / np.dtype(id_type(size)).itemsize + 1) / STRIDE))).first()[0] or 0


def warm_windows(texts: DataFrame, size: int, most: int) -> np.ndarray:
    """At most ``most`` different windows, those with the least hash; all of a corpus that has no more."""
    share = min(1.0, 2 * most / max(window_count(texts, size), 1))
    while True:
        limit = int(share * (1 << 31))

        def work(batches: Iterator[pa.RecordBatch], limit: int = limit) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "ids"):
                windows = windows_of(part.column("ids").to_pylist(), size)
                mixed = hashed(windows)
                of = np.flatnonzero(mixed < limit)
                yield pa.RecordBatch.from_arrays([pa.array(mixed[of].astype(np.int64)), pa.array([x.tobytes() for x in windows[of]], pa.binary())], names=["hash", "ids"])

        # copies of a window have one hash: what the cut leaves is made different before it is counted
        sample = texts.select("ids").mapInArrow(work, "hash long, ids binary").distinct().orderBy("hash", "ids").limit(most).collect()
        if len(sample) == most or share == 1.0:
            return np.frombuffer(b"".join(bytes(r["ids"]) for r in sample), np.int32).reshape(-1, CONTEXT + STRIDE)
        share = min(1.0, 4 * share)


def clusters(x: np.ndarray, k: int, weight: np.ndarray, seed: int = 1) -> np.ndarray:
    """k-means; rows without weight go to the nearest centre too."""
    rng = np.random.default_rng(seed)
    heavy = np.argsort(-weight)[: max(4 * k, 1)]
    centre = x[rng.choice(heavy, k, replace=len(heavy) < k)]
    for _ in range(12):
        near = (-2 * x @ centre.T + (centre**2).sum(1)).argmin(1)
        for j in range(k):
            if (of := weight * (near == j)).sum() > 0:
                centre[j] = (of[:, None] * x).sum(0) / of.sum()
    return near


def slots(total: np.ndarray) -> np.ndarray:
    """The number of each id among the signs, the most frequent ids; -1 for the others."""
    signs = np.argsort(-total, kind="stable")[:SIGNS]
    slot = np.full(len(total), -1)
    slot[signs] = np.arange(len(signs))
    return slot


def neighbours(windows: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """How often each id has each sign in its window."""
    near = np.zeros((len(slot), SIGNS), np.int64)
    for i in range(0, len(windows), 256):
        part = windows[i : i + 256]
        row, column = np.nonzero(slot[part] >= 0)
        seen = np.bincount(row * SIGNS + slot[part][row, column], minlength=len(part) * SIGNS).reshape(-1, SIGNS).astype(np.float32)
        own, code = np.unique(part, return_inverse=True)
        at = np.arange(len(part))[:, None] * len(own) + code.reshape(part.shape)
        times = np.bincount(at.ravel(), minlength=len(part) * len(own)).reshape(-1, len(own)).astype(np.float32)
        near[own] += (times.T @ seen).astype(np.int64)  # exact: far below 2**24
    return near


def all_neighbours(texts: DataFrame, slot: np.ndarray) -> np.ndarray:
    """``neighbours`` over all windows of the corpus. A task hands on a row per id, and so do all of them to the driver."""
    size, columns = len(slot), [f"n{i}" for i in range(SIGNS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros((size, SIGNS), np.int64)
        for part in slices(batches, "ids"):
            near += neighbours(windows_of(part.column("ids").to_pylist(), size), slot)
        ids = np.flatnonzero(near.any(axis=1))
        for i in range(0, len(ids), 4096):
            some = ids[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *map(pa.array, np.ascontiguousarray(near[some].T))], names=["id", *columns])

    schema = "id int, " + ", ".join(f"{c} long" for c in columns)
    rows = texts.select("ids").mapInArrow(work, schema).groupBy("id").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    near = np.zeros((size, SIGNS), np.int64)
    near[rows.column("id").to_numpy()] = np.column_stack([rows.column(c).to_numpy() for c in columns])
    return near


def classed(total: np.ndarray, begins: np.ndarray, windows: np.ndarray | None, near: np.ndarray | None = None) -> Model:
    """Embedding places and classes from the corpus's subword counts; rare subwords are put
    together by what stands near them in ``windows``, or by ``near``, counted before."""
    size = len(total)
    order = np.argsort(-total, kind="stable")
    place = OWN + np.arange(size) % POOL
    place[order[:OWN]] = np.arange(min(OWN, size))
    near = (neighbours(windows, slots(total)) if near is None else near).astype(np.float32)
    weight = near.sum(1)
    near = np.sqrt((near + near.sum(0) / max(near.sum(), 1) * 5) / (weight[:, None] + 5))
    group, share = np.zeros(size, np.int64), np.zeros(size)
    smooth = total + 0.1
    for side in (True, False):
        of = order[begins[order] == side]
        group[of[:ALONE]] = np.arange(min(ALONE, len(of)))
        if len(rest := of[ALONE:]):
            group[rest] = ALONE + clusters(near[rest], SIDE - ALONE, total[rest].astype(float) + 1e-3)
        share[of] = np.log(smooth[of] / np.bincount(group[of], weights=smooth[of], minlength=SIDE)[group[of]])
    return Model(place, begins.astype(np.int64), group, share)


def averaged(texts: DataFrame, workers: int, model, rate: float, low: float = 0.0, high: float = 1.0, passes: int = 1) -> dict[str, np.ndarray]:
    """The mean of the weights that workers reach on their own windows of a round, by number of windows. A task takes up to
    ``FAN`` workers, one after the other, and hands on one row; ``FAN`` rows meet in a task, step by step, until no more
    than that are left for the driver."""
    names = list(model.value.w)
    schema = "part int, n long, w binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for worker, ids in by_worker(batches):
            windows = in_round(windows_of(ids, len(model.value.place)), low, high)
            if len(windows):
                w = fitted(model.value, windows, passes, rate, worker)
                total = total + len(windows) * np.concatenate([w[k].ravel() for k in names]).astype(float)
                n += len(windows)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()),
                                              pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["part", "n", "w"])

    def mean(rows: pa.Table) -> pa.Table:
        n = np.array(rows.column("n").to_pylist(), float)
        total = sum(k * np.frombuffer(w, np.float32).astype(float) for k, w in zip(n, rows.column("w").to_pylist()))
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()),
                         "w": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    tasks = task_count(texts, workers)
    fits = texts.coalesce(tasks).mapInArrow(work, schema)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        fits = fits.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(mean, schema)
    parts = fits.collect()
    if not parts:
        return model.value.w
    total = sum(r["n"] for r in parts)
    flat = sum(r["n"] / total * np.frombuffer(r["w"], np.float32).astype(float) for r in parts).astype(np.float32)
    out, at = {}, 0
    for k in names:
        shape = model.value.w[k].shape
        out[k] = flat[at : at + int(np.prod(shape))].reshape(shape)
        at += int(np.prod(shape))
    return out


def by_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The ids of all texts of one worker after the other; the rows of each follow each other."""
    now, ids = None, []
    for batch in batches:
        for worker, text in zip(batch.column("worker").to_pylist(), batch.column("ids").to_pylist()):
            if worker != now and ids:
                yield now, ids
                ids = []
            now = worker
            ids.append(text)
    if ids:
        yield now, ids


def task_count(texts: DataFrame, workers: int) -> int:
    """Tasks for the texts of all workers: some for each core, and no more than ``FAN`` workers in one."""
    return min(workers, max(4 * texts.sparkSession.sparkContext.defaultParallelism, -(-workers // FAN)))


def trained(docs: DataFrame, counts: DataFrame, vocabulary, texts: DataFrame | None = None) -> Model:
    """The model of ``texts``, which are the training texts of ``docs`` where they were not dealt before."""
    texts = cut(training_texts(docs, vocabulary)) if texts is None else texts
    workers = (texts.agg(F.max("worker")).first()[0] or 0) + 1
    total, begins, size = subword_counts(counts, vocabulary), starts_word(vocabulary.value), size_of(vocabulary.value)
    windows, passes = window_count(texts, size), 1
    if windows <= WARM:
        ids = warm_windows(texts, size, WARM)
        model = classed(total, begins, ids).start()
        if not len(ids):
            return model
        model.w, rounds = fitted(model, ids, 3, 0.01, 1), ONE_ROUND
    else:
        model, rounds = classed(total, begins, None, all_neighbours(texts.coalesce(task_count(texts, workers)), slots(total))).start(), ROUNDS
        passes = min(PASSES, -(-MANY // windows))
    low = 0.0
    for rate, high in rounds:
        model.w = averaged(texts, workers, docs.sparkSession.sparkContext.broadcast(model), rate, low, high, passes)
        low = high
    return model


def scored(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``
    and ``attention_score`` (log10) of every document."""
    spark = docs.sparkSession
    with open(path, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    rows = docs.select("doc_id", "text", in_fold(F.col("doc_id"), 7, 2).alias("held_out"))
    encoded = cut(dealt(rows, vocabulary, block))
    asked = kept(block_words(encoded, vocabulary), "lm-block-words")
    counts = kept(asked.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "lm-words")
    found = counts.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_kinds, n_all = found["kinds"], found["n"]
    model = spark.sparkContext.broadcast(trained(rows, counts, vocabulary, encoded.filter(~F.col("held_out")).select("worker", "ids")))
    # a frequent word has a row per block here; AQE splits such a partition
    answers = asked.select("block", "at", "word").join(counts, "word").select("block", "at", "n")
    schema = extended(rows.select("doc_id", "held_out").schema,
                      "n_tokens long, n_known long, train_tokens long, base_score double, score double, attention_score double")

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Encoded(docs.column("ids").to_pylist(), vocabulary.value)
        n = np.zeros(texts.kinds + 1, np.int64)  # the last is the end; a word without a count has no answer
        n[answers.column("at").to_numpy()] = answers.column("n").to_numpy()
        # each text's words, then its end
        length = texts.count + 1
        to = np.cumsum(length)
        at_end = np.zeros(int(length.sum()), bool)
        at_end[to - 1] = True
        code = np.full(len(at_end), texts.kinds)
        code[~at_end] = texts.code
        per_text = lambda x: np.add.reduceat(x, to - length)
        base = np.log10((n + 1) / (n_all + n_kinds + 1))[code]

        windows, wanted = laid_out(texts.ids, texts.ids_per_text, size_of(vocabulary.value) - 1)
        # equal windows are predicted once, so equal texts have equal scores to the last digit
        different, same = np.unique(windows, axis=0, return_inverse=True)
        chosen, start = (x.reshape(-1, STRIDE)[same.ravel()].ravel()[wanted] for x in predicted(model.value, different))
        # the ids of one word (or the end) are consecutive; a word's end is the next one's start
        width = np.ones(len(code), np.int64)
        width[~at_end] = texts.size
        first = np.cumsum(width) - width
        log_word = np.add.reduceat(chosen, first) - start[first]
        log_word[~at_end] += start[(first + width)[~at_end]]
        attention = per_text(log_word) / np.log(10)
        return pa.table([docs.column("doc_id"), docs.column("held_out"), pa.array(length), pa.array(per_text((n > 0).astype(np.int64)[code])),
                         pa.array(np.full(len(docs), n_all, np.int64)), pa.array(per_text(base)), pa.array(attention), pa.array(attention)],
                        names=schema.names)

    # dealt by hand: AQE would put many blocks into a task, as their ids are small
    blocks = encoded.select("doc_id", "held_out", "block", "ids").repartition(part_count(spark), "block")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)

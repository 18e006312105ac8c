"""Hard negatives by score bounds along spanning trees of the anchors.

Anchors of one label whose vectors point the same way (signs of their first components) form blocks of
about ``BLOCK``. A block is one task: its minimum spanning tree under Euclidean distance. Whoever
scores rows against a block starts at the root with all rows. At a child, a row's score lies within
the parent's, or the parent's bounds, plus or minus edge length times norm of the row. Only rows
whose bounds overlap what is wanted are scored again; the others go on with their bounds.

Two passes over the rows: the first wants the ``POSITIVES`` best rows of the anchor's label, so
its window is open above and starts at the last one held; the second wants, for each
positive, the ``NEGATIVES`` best rows of other labels in the window that the positive's score sets,
which starts higher once that many are held. Each task keeps only these few per anchor and hands them on.

The anchors are the stated query set. They meet all rows in waves of at most about ``WAVE`` bytes of
vectors, each of which is sent to all tasks; the rows themselves are never shuffled.

Scores are exact: products are computed in doubles where norms keep them below 2^53, otherwise
in whole numbers of any size. A component or score beyond 64 bits counts as the nearest 64-bit number.

Rows: without ``vec_id``, ``label`` or vector, or with a null or non-finite component a row takes no
part. Components that one of two vectors lacks count as zero. Rows alike in id and score count once as
a partner; anchors alike in id, label and vector are one. "Other rows" are rows of another id. No
anchors, or an empty table, give no rows. Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeframe.llm.common import kept

SCALE = 256
ANCHORS = 100
POSITIVES = NEGATIVES = 5
#: Negatives score at least this share (in per cent) of the positive.
SHARE = 80
BLOCK = 512
WAVE = 64_000_000
#: Rows that are compared at a time.
ROWS = 4_096
LARGEST = (1 << 63) - 1

Held = list[tuple[int, int]]  # score with its sign turned, id: best first


def vectors(table: DataFrame, relabel: Column) -> DataFrame:
    """``vec_id``, ``label`` (as ``relabel`` says) and ``v``, whole numbers, of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select("vec_id", "label", "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), relabel.cast("int").alias("label"), F.transform(
        "embedding", lambda x: F.floor(SCALE * x.cast("double"))).alias("v"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(float) ** 2).sum(axis=1))


def tree(block: pa.Table) -> pa.Table:
    """Minimum spanning tree of the anchors of a block (Prim): ``place`` from 0, parents before their
    children, ``parent`` (-1 at the root) and ``edge``, the distance to it, rounded up."""
    rows = matrix(block.column("v")).astype(float)
    n = len(rows)
    order, parent, edge = [], np.full(n, -1), np.zeros(n)
    near, by, open_ = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    # the root is the anchor nearest to the middle, its ties by the order of ids
    first = np.lexsort((block.column("vec_id").to_numpy(), norms(rows - rows.mean(axis=0))))[0]
    near[first] = 0
    for _ in range(n):
        i = int(np.argmin(np.where(open_, near, np.inf)))
        open_[i] = False
        parent[i], edge[i] = by[i], near[i]
        order.append(i)
        d = norms(rows - rows[i])
        closer = open_ & (d < near)
        near[closer], by[closer] = d[closer], i
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    found = block.append_column("place", pa.array(place.astype(np.int32)))
    found = found.append_column("parent", pa.array(np.where(parent < 0, -1, place[parent]).astype(np.int32)))
    return found.append_column("edge", pa.array(edge * (1 + 1e-9)))


def forest(anchors: DataFrame) -> DataFrame:
    """``anchors`` in blocks (``block``), each a spanning tree. A cell of equal signs that holds more than a
    block is dealt to several; the anchors of a block share their label."""
    n = anchors.count()
    signs = min(max(math.ceil(math.log2(max(n, 1) / BLOCK)), 0), 24)
    cell = F.xxhash64("label", F.transform(F.slice("v", 1, signs), lambda x: x >= 0)) if signs else F.xxhash64("label")
    placed = anchors.withColumn("cell", cell)
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = placed.join(parts, "cell").select(
        "vec_id", "label", "v", F.xxhash64("cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).alias("block"))
    return dealt.groupBy("block").applyInArrow(tree, "vec_id long, label int, v array<long>, block long, place int, parent int, edge double")


@dataclass
class Tree:
    """A block of anchors. ``windows``: for each anchor the positives it has, as (score, id)."""

    block: int
    label: int
    ids: list[int]
    rows: np.ndarray
    parent: list[int]
    edge: list[float]
    windows: list[list[tuple[int, int]]] = field(default_factory=list)

    def norm(self) -> float:
        return float(norms(self.rows).max())


def trees(table: pa.Table) -> list[Tree]:
    """The trees of a wave, from rows of ``forest`` (with ``positives`` in the second pass)."""
    table = table.sort_by([("block", "ascending"), ("place", "ascending")])
    rows = matrix(table.column("v"))
    blocks = table.column("block").to_numpy()
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else []
    out = []
    for a, b in zip(starts, [*starts[1:], len(blocks)]):
        part = table.slice(a, b - a)
        held = part.column("positives").to_pylist() if "positives" in part.column_names else []
        out.append(Tree(int(blocks[a]), part.column("label")[0].as_py(), part.column("vec_id").to_pylist(), rows[a:b],
                        part.column("parent").to_pylist(), part.column("edge").to_pylist(),
                        [[(p["score"], p["id"]) for p in line or []] for line in held]))
    return out


class Rows:
    """Some rows to be scored, in doubles or, if their products may pass 2^53, in Python's numbers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, norm: np.ndarray, most: float) -> None:
        self.ids, self.norm = ids, norm
        self.exact = float(norm.max(initial=0)) * most < 1 << 52
        self.rows = rows.astype(float) if self.exact else rows.astype(object)

    def scores(self, anchor: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """Scores of all rows, or of the chosen ones."""
        width = min(len(anchor), self.rows.shape[1])
        rows = self.rows[:, :width] if which is None else self.rows[which, :width]
        if self.exact:
            return rows @ anchor[:width].astype(float)
        return np.clip(rows @ anchor[:width].astype(object), -LARGEST - 1, LARGEST)


def walked(tree: Tree, rows: Rows, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor of the tree (by place) the numbers of the rows that were scored and their scores.
    ``wanted(place, low, high)`` says whose bounds overlap what is wanted there."""
    low = np.empty((len(tree.ids), len(rows.ids)))
    high = np.empty_like(low)
    for place, (parent, edge) in enumerate(zip(tree.parent, tree.edge)):
        if parent < 0 or not rows.exact:
            score = rows.scores(tree.rows[place])
            if rows.exact:
                low[place] = high[place] = score
            yield place, np.arange(len(rows.ids)), score
            continue
        reach = edge * rows.norm + 2
        low[place], high[place] = low[parent] - reach, high[parent] + reach
        again = np.flatnonzero(wanted(place, low[place], high[place]))
        # a copy of some rows costs more than the product of all
        score = rows.scores(tree.rows[place])[again] if 2 * len(again) > len(rows.ids) else rows.scores(tree.rows[place], again)
        low[place, again] = high[place, again] = score
        yield place, again, score


def merged(held: Held, score: np.ndarray, ids: np.ndarray, most: int) -> None:
    """Take the best of ``held`` and the given rows; rows alike in score and id count once."""
    if score.dtype == object:
        found = sorted({(-int(s), int(i)) for s, i in zip(score, ids)})[:most]
    else:
        order = np.lexsort((ids, -score))
        s, i = score[order], ids[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        found = [(-int(x), int(y)) for x, y in zip(s[new][:most], i[new][:most])]
    held[:] = sorted({*held, *found})[:most]


def parts(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[tuple[np.ndarray, "callable"]]:
    """Labels of some rows, and a function that gives the rows chosen by a mask."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            ids, v = part.column("vec_id").to_numpy(), matrix(part.column("v"))
            norm = norms(v)
            yield part.column("label").to_numpy(), lambda mask, ids=ids, v=v, norm=norm: Rows(ids[mask], v[mask], norm[mask], most)


def best_positives(rows: DataFrame, wave: list[Tree]) -> DataFrame:
    """``block``, ``place``, ``score``, ``id``: from each task the best rows of each anchor's label."""
    sent = rows.sparkSession.sparkContext.broadcast(wave)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = sent.value
        best: list[list[Held]] = [[[] for _ in tree.ids] for tree in wave]
        for labels, chosen in parts(batches, max((t.norm() for t in wave), default=0)):
            here = {label: chosen(labels == label) for label in {t.label for t in wave}}
            for tree, held in zip(wave, best):
                some = here[tree.label]
                if not len(some.ids):
                    continue

                def wanted(place, low, high, held=held):
                    line = held[place]
                    return high >= -line[-1][0] if len(line) == POSITIVES else np.ones(len(high), bool)

                for place, which, score in walked(tree, some, wanted):
                    other = some.ids[which] != tree.ids[place]
                    merged(held[place], score[other], some.ids[which][other], POSITIVES)
        flat = [(tree.block, place, -s, i) for tree, held in zip(wave, best) for place, line in enumerate(held) for s, i in line]
        yield table(flat, ("block", "place", "score", "id"))

    return rows.mapInArrow(work, "block long, place int, score long, id long")


def best_negatives(rows: DataFrame, wave: list[Tree]) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``positive_score``, ``negative_id``, ``negative_score``: from each task the best
    rows of other labels in each positive's window."""
    sent = rows.sparkSession.sparkContext.broadcast(wave)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = sent.value
        best: list[list[list[Held]]] = [[[[] for _ in line] for line in tree.windows] for tree in wave]
        # the least score that is at least the share of the positive's
        least = [[[-(-SHARE * score // 100) for score, _ in line] for line in tree.windows] for tree in wave]
        for labels, chosen in parts(batches, max((t.norm() for t in wave), default=0)):
            here = {label: chosen(labels != label) for label in {t.label for t in wave}}
            for tree, held, starts in zip(wave, best, least):
                some = here[tree.label]
                if not len(some.ids):
                    continue

                def windows(place, tree=tree, held=held, starts=starts):
                    for (score, _), line, start in zip(tree.windows[place], held[place], starts[place]):
                        start = max(start, -line[-1][0]) if len(line) == NEGATIVES else start
                        if start <= score:
                            yield line, start, score

                def wanted(place, low, high, windows=windows):
                    found = np.zeros(len(low), bool)
                    for _, start, end in windows(place):
                        found |= (high >= start) & (low <= end)
                    return found

                for place, which, score in walked(tree, some, wanted):
                    ids = some.ids[which]
                    for line, start, end in windows(place):
                        inside = ((score >= start) & (score <= end)).astype(bool)
                        if inside.any():
                            merged(line, score[inside], ids[inside], NEGATIVES)
        flat = [(tree.ids[place], positive, score, i, -s) for tree, held in zip(wave, best)
                for place, lines in enumerate(held) for (score, positive), line in zip(tree.windows[place], lines) for s, i in line]
        yield table(flat, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    return rows.mapInArrow(work, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")


def table(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "place" else pa.int64()) for n, c in zip(names, columns)], names=list(names))


def ranked(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """``df`` without repeated rows, with ``rank`` within ``keys``: higher scores first, then smaller ids."""
    return df.distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), name)))


def mined(table: DataFrame, relabel: Column | None = None) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``. ``relabel`` is the
    label to use; every seventh id has the next one if it is not given."""
    if relabel is None:
        relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = kept(vectors(table, relabel), "negatives-rows")
    anchors = rows.filter(F.col("vec_id") % ANCHORS == 0).distinct()
    planted = kept(forest(anchors), "negatives-trees")
    size = planted.agg(F.sum(F.size("v") * 8 + 100)).first()[0] or 0
    waves = int(size // WAVE) + 1
    out = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    for i in range(waves):
        wave = planted.filter(F.pmod("block", F.lit(waves)) == i)
        here = trees(wave.toArrow())
        if not here:
            continue
        found = ranked(best_positives(rows, here), ["block", "place"], "score", "id").filter(F.col("rank") <= POSITIVES)
        lists = found.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
        with_windows = trees(wave.join(lists, ["block", "place"], "left").toArrow())
        out = out.unionByName(best_negatives(rows, with_windows))
    return ranked(out, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id").filter(
        F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

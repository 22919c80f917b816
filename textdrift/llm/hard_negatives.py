"""Operator 12, hard-negative mining by threshold joins over an inverted index (L2AP style).

Each component x of a vector becomes floor(256 x); a score is the integer inner product of two such
vectors. An anchor (``vec_id`` divisible by ``every``) has as positives its first ``positives`` other
rows of the same label, and for each positive the first ``negatives`` rows of other labels whose
score lies in a window relative to the positive's: ``least`` s <= 100 t <= ``most`` s. Higher scores
come first, ties by smaller ``vec_id``.

Both searches are threshold joins. Rows are dealt into stripes and anchors into blocks, and one task
holds a block of anchors and a stripe of rows. For the threshold t the stripe's inverted index has,
for each group of dimensions, the rows that are listed there; a row's leading dimensions are left out
of the index as long as the norm of that prefix, times the anchor's norm, stays below t, since a
pair that meets only there can't reach t. Scores are accumulated from the last dimension group to
the first; a pair is dropped once its partial score and the product of the norms of what remains
of both vectors stay below t. What is left is scored exactly. Anchors whose window is not yet
full in the stripe go on with a lower threshold, at last with none. So every stripe gives the first
rows it can contribute, and Spark merges them: the result is exact.

Bounds: a task holds ``STRIPE`` rows and ``BLOCK`` anchors and works on ``TILE_ROWS`` x
``TILE_ANCHORS`` pairs at a time. A stripe hands on one row for an anchor, with at most ``positives``
entries, or at most ``negatives`` for each window.

Defined results: rows with a null ``vec_id``, label or vector or a null or non-finite component take
no part; missing trailing components count as 0; an anchor's partners are the rows with another
``vec_id``, repeated rows counted each, but an anchor repeated under one ``vec_id`` counts once (its
least label and vector); anchors without positives, or with an empty window, give no rows. Products
must fit 64 bits: components up to 2^27 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textdrift.llm.tables import written

STRIPE, BLOCK = 1 << 14, 1 << 12
TILE_ROWS, TILE_ANCHORS, GROUP = 1 << 13, 1 << 8, 8
#: Thresholds that are tried in turn, as shares of the product of the largest norms.
LEVELS = (0.9, 0.6, 0.45, 0.3, 0.15)
#: While more than this share of a tile's pairs lives, they are accumulated as a matrix.
DENSE = 0.05
#: Pairs that are scored exactly at a time.
PAIRS = 1 << 16
MOST_TASKS = 20_000


@dataclass(frozen=True)
class Options:
    """The mining task: anchors, positives, windows in percent, and the label shift."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    least: int = 30
    most: int = 90
    shifted: int = 7


def prepared(embeddings: DataFrame, options: Options) -> DataFrame:
    """vec_id, label and the integer vector of every row that takes part."""
    whole = F.expr("forall(embedding, x -> x IS NOT NULL AND abs(double(x)) < double('infinity'))")
    label = F.when(F.col("vec_id") % options.shifted == 0, (F.col("label").cast("long") + 1) % 10).otherwise(
        F.col("label"))
    return embeddings.select("vec_id", "label", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.expr("transform(embedding, x -> floor(256 * cast(x AS double)))").alias("v"))


def matrix(column: pa.Array, order: np.ndarray) -> np.ndarray:
    """Vectors as rows, their dimensions in ``order``; missing components are 0. Exact as floats as
    long as no sum can pass 2^53, else as 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.list_value_length(column))
    out = np.zeros((len(column), len(order)), np.int64)
    at = np.arange(len(order))[None, :] < sizes[:, None]
    out[at] = np.asarray(column.flatten())
    out = out[:, order]
    largest = float(np.abs(out).max()) if out.size else 0.0
    return out.astype(float) if largest ** 2 * len(order) < 2.0 ** 52 else out


class Index:
    """Some rows for joins at a threshold: norms of the prefixes of each row's dimension groups."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.groups = [slice(a, min(a + GROUP, vectors.shape[1])) for a in range(0, vectors.shape[1], GROUP)]
        self.norms = prefix_norms(vectors, self.groups)

    def tiles(self, share: float) -> Iterator[Tile]:
        for a in range(0, len(self.vectors), TILE_ROWS):
            yield Tile(self, np.arange(a, min(a + TILE_ROWS, len(self.vectors))), share)


def prefix_norms(vectors: np.ndarray, groups: list[slice]) -> np.ndarray:
    """Norm of the dimensions before each group, and of all; a little too large rather than too small."""
    squares = np.stack([np.zeros(len(vectors)), *((vectors[:, g].astype(float) ** 2).sum(1) for g in groups)], 1)
    return np.sqrt(np.cumsum(squares, 1)) * (1 + 1e-12)


class Tile:
    """The inverted index of some rows. ``rows`` are sorted by their first indexed group, so that the
    list of a group is a prefix of them: ``listed[g]`` rows."""

    def __init__(self, index: Index, rows: np.ndarray, share: float):
        """``share``: the least threshold over the norm of its anchor. A row's leading groups are left
        out as long as the norm of that prefix stays below it."""
        first = (index.norms[rows, 1:] < share).sum(1)
        order = np.argsort(first, kind="stable")
        self.index, self.rows, self.first = index, rows[order], first[order]
        self.listed = np.searchsorted(self.first, np.arange(len(index.groups)), "right")

    def _rest(self, norms: np.ndarray, g: int, anchors, places) -> np.ndarray:
        """Bound of what is not yet accumulated once group ``g`` is: the groups before it, or all that
        are left out of the index."""
        at = np.maximum(g, self.first[places])
        return norms[anchors, at] * self.index.norms[self.rows[places], at]

    def join(self, anchors: np.ndarray, norms: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, place in ``rows``): a superset of the pairs whose score reaches the threshold."""
        index, groups = self.index, self.index.groups
        partial = np.zeros((len(anchors), len(self.rows)), anchors.dtype)
        everyone, all_places = np.arange(len(anchors))[:, None], np.arange(len(self.rows))[None, :]
        pairs = sums = None
        for g in range(len(groups) - 1, -1, -1):
            n = int(self.listed[g])
            if pairs is None:
                partial[:, :n] += anchors[:, groups[g]] @ index.vectors[self.rows[:n], groups[g]].T
                if g and g > len(groups) // 2:
                    continue
                alive = partial + self._rest(norms, g, everyone, all_places) >= thresholds[:, None]
                if alive.mean() <= DENSE or not g:
                    pairs = np.nonzero(alive)
                    sums = partial[pairs]
            else:
                here = pairs[1] < n
                a, r = pairs[0][here], self.rows[pairs[1][here]]
                sums[here] += np.einsum("ij,ij->i", anchors[a][:, groups[g]], index.vectors[r][:, groups[g]])
                alive = sums + self._rest(norms, g, *pairs) >= thresholds[pairs[0]]
                pairs, sums = (pairs[0][alive], pairs[1][alive]), sums[alive]
        return pairs


def threshold_join(index: Index, anchors: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple]:
    """(anchor, row, score) arrays with all pairs whose score reaches the anchor's threshold."""
    norms = prefix_norms(anchors, index.groups)
    thresholds = thresholds - np.abs(thresholds) * 1e-9
    share = float((thresholds / np.maximum(norms[:, -1], 1e-9)).min()) if len(anchors) else 0.0
    for tile in index.tiles(share):
        for a in range(0, len(anchors), TILE_ANCHORS):
            part = slice(a, a + TILE_ANCHORS)
            who, place = tile.join(anchors[part], norms[part], thresholds[part])
            for i in range(0, len(who), PAIRS):
                some, rows = who[i:i + PAIRS], tile.rows[place[i:i + PAIRS]]
                score = np.einsum("ij,ij->i", anchors[part][some], index.vectors[rows])
                hit = score >= thresholds[part][some]
                yield some[hit] + a, rows[hit], score[hit].astype(np.int64)


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: by score descending, then id."""
    order = np.lexsort((ids, -score, group))
    start = np.searchsorted(group[order], group[order], "left")
    return order[np.arange(len(order)) - start < k]


@dataclass
class Side:
    """Ids, labels and vectors of some rows."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, order: np.ndarray) -> Side:
        return cls(table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["v"], order))


def search(rows: Side, anchors: Side, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple:
    """(anchor, window, row, score) of the first ``k`` rows of each window: those with the anchor's
    label (``same``) or any other, and with scores from ``low`` to ``high`` (anchors x windows)."""
    index, width = Index(rows.vectors), low.shape[1]
    best_norm = float(index.norms[:, -1].max(initial=0.0))
    # no row scores more than the product of the norms, and no window takes more than its end
    top = np.minimum(best_norm * np.sqrt((anchors.vectors.astype(float) ** 2).sum(1)), high.max(1).astype(float))
    worst = np.where(low <= high, low, high.max()).min(1).astype(float)
    found, todo = [], np.flatnonzero((low <= high).any(1))
    for level in (*LEVELS, None):
        if not len(todo):
            break
        t = worst[todo]
        if level is not None:
            t = np.maximum(t, np.where(top[todo] > 0, top[todo] * level, t))
        best = [np.zeros(0, np.int64)] * 3
        for who, row, score in threshold_join(index, anchors.vectors[todo], t):
            who = todo[who]
            fits = (rows.ids[row] != anchors.ids[who]) & ((rows.labels[row] == anchors.labels[who]) == same)
            who, row, score = who[fits], row[fits], score[fits]
            for w in range(width):
                inside = (score >= low[who, w]) & (score <= high[who, w])
                more = (who[inside] * width + w, row[inside], score[inside])
                best = [np.append(x, y) for x, y in zip(best, more)]
            keep = first_of(best[0], best[2], rows.ids[best[1]], k)
            best = [x[keep] for x in best]
        full = np.bincount(best[0], minlength=len(low) * width).reshape(-1, width)[todo] >= k
        done = (full | (low[todo] > high[todo]) | (low[todo] >= t[:, None])).all(1)
        settled = np.isin(best[0] // width, todo[done])
        found.append([x[settled] for x in best])
        todo = todo[~done]
    window, row, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    return window // width, window % width, row, score


_FOUND = "anchor_id long, window int, id long, score long"


def _joined(rows: DataFrame, anchors: DataFrame, stripes: int, blocks: int, order: np.ndarray, same: bool,
            k: int) -> DataFrame:
    """anchor_id, window, id, score of the first ``k`` rows of each window of ``anchors`` (vec_id,
    label, v, low, high): found in each stripe, then merged."""
    dealt = rows.withColumn("stripe", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(stripes))
                            ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("stripe", F.col("stripe").cast("int"))

    def task(some: pa.Table, wanted: pa.Table) -> pa.Table:
        if some.num_rows and wanted.num_rows:
            side, asking = Side.of(some, order), Side.of(wanted, order)
            low, high = (np.stack(wanted[c].to_pylist()).astype(np.int64) for c in ("low", "high"))
            who, window, row, score = search(side, asking, low, high, same, k)
            names, ids = asking.ids[who], side.ids[row]
        else:
            names = window = ids = score = np.zeros(0, np.int64)
        columns = [pa.array(names), pa.array(window.astype(np.int32)), pa.array(ids), pa.array(score)]
        starts = pa.array([0, len(names)], pa.int32())
        lists = [pa.ListArray.from_arrays(starts, c) for c in columns]
        return pa.table(lists, names=["anchor_id", "window", "id", "score"])

    # one row of lists for a stripe and block, so that no intermediate row count grows with both
    lists = ", ".join(f"{name} array<{kind}>" for name, kind in (x.split() for x in _FOUND.split(", ")))
    tasks = min(stripes * blocks, MOST_TASKS)       # dealt here, so that small groups aren't put together again
    dealt, asked = (x.repartition(tasks, "stripe", "block") for x in (dealt, asked))
    found = dealt.groupBy("stripe", "block").cogroup(asked.groupBy("stripe", "block")).applyInArrow(task, lists)
    found = found.select(F.explode(F.arrays_zip("anchor_id", "window", "id", "score")).alias("x")).select("x.*")
    first = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _energies(rows: DataFrame) -> DataFrame:
    """The sum of squares of each dimension."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            sizes = np.asarray(pc.list_value_length(column))
            dims = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            sums = np.bincount(dims, np.asarray(column.flatten()).astype(float) ** 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums.astype(float))],
                                             names=["dim", "energy"])

    return rows.select("v").mapInArrow(task, "dim long, energy double").groupBy("dim").agg(
        F.sum("energy").alias("energy"))


def mine(embeddings: DataFrame, options: Options = Options(), stripe: int = STRIPE, block: int = BLOCK) -> DataFrame:
    """Hard negatives of every anchor and positive of ``embeddings`` (vec_id, label, embedding):
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = prepared(embeddings, options)
    anchors = written(rows.where(F.col("vec_id") % options.every == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*"), "anchors")
    # the dimensions with least weight come first: these are left out of the index
    energies = _energies(rows).orderBy("energy", "dim").toArrow()
    order = energies["dim"].to_numpy()
    stripes, blocks = (max(1, -(-n // size)) for n, size in ((rows.count(), stripe), (anchors.count(), block)))

    ends = [F.array(F.lit(x).cast("long")) for x in (-(1 << 62), 1 << 62)]
    near = _joined(rows, anchors.withColumns({"low": ends[0], "high": ends[1]}), stripes, blocks, order, True,
                   options.positives)
    positives = written(near.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"),
                                    F.col("score").alias("positive_score")), "positives")
    # a missing positive has an empty window
    windows = positives.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "window", "positive_score"))).alias("s")).select(F.col("anchor_id").alias("vec_id"), *[
            F.expr(f"transform(sequence(0, {options.positives - 1}), w -> {end})").alias(name) for name, end in (
                ("low", f"coalesce(cast(ceil({options.least} * cast(s[w] AS decimal(20, 0)) / 100) AS bigint), 1L)"),
                ("high", f"coalesce(cast(floor({options.most} * cast(s[w] AS decimal(20, 0)) / 100) AS bigint), 0L)"))])
    far = _joined(rows, anchors.join(windows, "vec_id"), stripes, blocks, order, False, options.negatives)
    return far.join(positives, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))

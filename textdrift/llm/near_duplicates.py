"""Operator 10, MinHash near-duplicates with an LSH forest.

A document's set holds its distinct shingles (``size`` consecutive lower-cased words
``[^\\x20\\x09-\\x0D]+``; a shorter text is one shingle). Documents with equal sets become one
node. Each node has a signature of ``HASHES`` minima. The forest has ``TREES`` sorted orders of
the nodes: tree t sorts by its own ``DEPTH`` minima, then by further ones. Nodes that share a
tree's first minima form a region; a node's candidates are the ``NEIGHBOURS`` nodes next to it in
the order within its region, so that a small region is compared whole, while in a large one the
nodes with the longest common prefixes meet: the depth adapts to the region. Candidates whose
short sketches disagree too much (five standard deviations below the threshold) are left out.

Links are confirmed on the full sets. First each node's smallest and most similar candidates are
confirmed and joined into components; then every other candidate pair between two components.
What neighbours alone may miss is made up at the end by a prefix join of all crowded nodes, which
are those of any region larger than a neighbourhood, with candidates or without: the shingles of
the crowded nodes are counted, each node is listed under its rarest shingles (``prefixes``), and
nodes of different components under one shingle are compared, in blocks bounded on both sides.
Two similar sets always share a listed shingle, so this step has no cap of neighbours.

Two sets at the threshold share a tree's region with probability 0.8^3 = 0.51, so that all 21
trees miss them with probability 3e-7; a pair that shares a region is compared, as neighbours or
by the prefix join, unless its sketches disagree too much (at the threshold
with probability 1.1e-6).

Orders are dealt by range over (minima, id), which splits a region of any size; windows that
cross the ends of ranges are made up afterwards. Nothing per document reaches the driver.

Defined results: null, empty and blank texts have empty sets and are linked with nothing; equal
texts and repeated rows are linked; a null doc_id is never a component's smallest id unless the
component has no other; rows of one doc_id with different texts are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.llm import words as W
from textdrift.llm.components import components
from textdrift.llm.tables import free_prefix, quoted, written

HASHES, TREES, DEPTH, NEIGHBOURS = 64, 21, 3, 8
PART_NODES = 2048
BUCKETS = 1 << 20
THRESHOLD = (80, 100)
_FACTORS = np.random.default_rng(10).integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_SAME = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all documents, sorted within each; ptr of each document)."""
    found = W.find_words(data, offsets, W.SPACED, lower=True)
    hashes, counts = W.word_hashes(found), found.counts
    grams = W.window_hashes(hashes, size)
    ok = W.window_ends(found, size)[:len(grams)]
    doc = found.doc_of()[:len(grams)][ok]
    grams = grams[ok]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = [W.window_hashes(hashes[found.ptr[d]:found.ptr[d + 1]], int(counts[d]))[0] for d in short.tolist()]
        grams, doc = np.concatenate([grams, np.array(extra, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def _fingerprints(grams: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Two sums of mixed hashes per document: equal sets have equal sums."""
    sums = np.zeros((len(grams) + 1, 2), np.uint64)
    np.cumsum(W.mix(grams + np.uint64(0x51ED27)), out=sums[1:, 0])
    np.cumsum(W.mix(grams ^ np.uint64(0xA24BAED4963EE407)), out=sums[1:, 1])
    return sums[ptr[1:]] - sums[ptr[:-1]]


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    width = raw.itemsize * raw.shape[1]
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, fingerprint and signature (null without words)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            data, offsets = W.text_bytes(batch.column(2))
            for a, b in W.slices(data, offsets):
                grams, ptr = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                counts = np.diff(ptr)
                some = counts > 0
                minima = np.zeros((b - a, HASHES), np.uint32)
                if len(grams):
                    starts = ptr[:-1][some]
                    for j, factor in enumerate(_FACTORS):
                        minima[some, j] = np.minimum.reduceat(((grams * factor) >> np.uint64(32)).astype(np.uint32),
                                                              starts)
                absent = pa.array(some)
                prints = pa.compute.if_else(absent, _binary(_fingerprints(grams, ptr)), None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(counts, pa.int64()), prints,
                     pa.compute.if_else(absent, _binary(minima), None)],
                    names=["doc_id", "text_hash", "n_shingles", "fingerprint", "signature"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        task, "doc_id long, text_hash long, n_shingles long, fingerprint binary, signature binary")


def _minima(signature: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signature.to_pylist()), np.uint32).reshape(-1, HASHES)


def _sketches(minima: np.ndarray) -> pa.Array:
    nibbles = (minima & 15).astype(np.uint8)
    return _binary(nibbles[:, 0::2] | nibbles[:, 1::2] << 4)


def _trees(nodes: DataFrame) -> DataFrame:
    """A row for each node and tree: the region's key, the order in it, and the sketch."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            if not batch.num_rows:
                continue
            minima = _minima(batch.column(1))
            sketch = _sketches(minima)
            wide = minima.astype(np.uint64)
            for tree in range(TREES):
                at = tree * DEPTH
                key = np.full(len(wide), tree + 1, np.uint64)
                for j in range(DEPTH):
                    key = W.mix(key ^ wide[:, at + j]) * np.uint64(0x9E3779B97F4A7C15)
                order = []
                for half in range(2):
                    packed = np.zeros(len(wide), np.uint64)
                    for j in range(4):
                        packed = packed << np.uint64(16) | (wide[:, (at + DEPTH + 4 * half + j) % HASHES]
                                                            & np.uint64(0xFFFF))
                    order.append(packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (key, *order)] + [batch.column(0), sketch],
                    names=["key", "first", "second", "id", "sketch"])

    return nodes.select("id", "signature").mapInArrow(
        task, "key long, first long, second long, id long, sketch binary")


def _close(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray, least: int, done: int = 0):
    """Neighbours at most NEIGHBOURS apart with one key and ``least`` agreeing sketch values;
    the first ``done`` rows are not paired among themselves."""
    out = []
    for step in range(1, NEIGHBOURS + 1):
        at = np.flatnonzero(key[:-step] == key[step:])
        at = at[at + step >= done]
        if len(at):
            agree = _SAME[sketch[at] ^ sketch[at + step]].sum(axis=1, dtype=np.int32)
            at, agree = at[agree >= least], agree[agree >= least]
            x, y = ids[at], ids[at + step]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y), agree]))
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


def least_agreement(part: int, whole: int) -> int:
    """Sketch values that must agree: five standard deviations below the threshold."""
    share = part / whole
    expected = share + (1 - share) / 16
    return int(HASHES * expected - 5 * (HASHES * share * (1 - share)) ** 0.5)


def _in_long_runs(key: np.ndarray) -> np.ndarray:
    """True for each row in a run of more than NEIGHBOURS + 1 equal keys."""
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=-1)
    return np.repeat(sizes > NEIGHBOURS + 1, sizes)


def candidates(nodes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, agree): candidate pairs a < b of nodes with the sketch values in which they agree; and
    (id): the crowded nodes, those of regions larger than a neighbourhood (at the ends of a range
    also others, since the rest of their region may be in the next range)."""
    empty = np.zeros((0, HASHES // 2), np.uint8)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, ids, sketch, seen, head = np.zeros(0, np.int64), np.zeros(0, np.int64), empty, 0, 0
        first = None

        def batch_of(a, b, agree, place=None, keys=None, sketches=None) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int32()),
                 pa.nulls(n, pa.int64()) if place is None else pa.array(place, pa.int64()),
                 pa.nulls(n, pa.int64()) if keys is None else pa.array(keys, pa.int64()),
                 pa.nulls(n, pa.binary()) if sketches is None else _binary(sketches)],
                names=["a", "b", "agree", "place", "key", "sketch"])

        def edge(rows: slice, place: int) -> pa.RecordBatch:
            n = len(ids[rows])
            return batch_of(ids[rows], ids[rows], np.zeros(n), (part << 34) + place + np.arange(n), key[rows],
                            sketch[rows])

        def crowd(rows: np.ndarray) -> pa.RecordBatch:
            some = np.unique(ids[rows])
            return batch_of(some, some, np.zeros(len(some)))

        for batch in W.frugal(batches):
            if not batch.num_rows:
                continue
            done = len(ids)
            key = np.concatenate([key, np.asarray(batch.column(0))])
            ids = np.concatenate([ids, np.asarray(batch.column(1))])
            sketch = np.concatenate([sketch, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
                                     .reshape(-1, HASHES // 2)])
            if head < NEIGHBOURS:
                more = slice(done, done + NEIGHBOURS - head)
                yield edge(more, seen)
                head += len(ids[more])
            yield batch_of(*_close(key, ids, sketch, least, done))
            first = key[0] if first is None else first
            yield crowd(_in_long_runs(key) | (key == first))
            seen += batch.num_rows
            kept = slice(-NEIGHBOURS - 1, None)      # a long run has its last rows here, or begins in them
            key, ids, sketch = key[kept], ids[kept], sketch[kept]
        if len(ids):
            yield edge(slice(None), seen - len(ids))
            yield crowd(key == key[-1])

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("place").sort_values("place")
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, HASHES // 2)
        a, b, agree = _close(frame["key"].to_numpy(), frame["a"].to_numpy(), sketch, least)
        return pd.DataFrame({"a": a, "b": b, "agree": agree.astype(np.int32)})

    order = ["key", "first", "second", "id"]
    ordered = _trees(nodes).repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ordered.select("key", "id", "sketch").mapInArrow(
        windows, "a long, b long, agree int, place long, key long, sketch binary"), "forest")
    # the ends of the ranges: 2 * NEIGHBOURS rows for each task of the order, in one task
    crossing = found.where("place IS NOT NULL").groupBy(F.lit("ends")).applyInPandas(ends, "a long, b long, agree int")
    pairs = found.where("place IS NULL").select("a", "b", "agree").union(crossing).where("a != b")
    crowded = found.where("place IS NULL AND a = b").select(F.col("a").alias("id")).distinct()
    return pairs.groupBy("a", "b").agg(F.max("agree").alias("agree")), crowded


def _sets(documents: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(id, grams): the full set of each given node."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            data, offsets = W.text_bytes(batch.column(2))
            for a, b in W.slices(data, offsets):
                grams, ptr = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                prints = _fingerprints(grams, ptr)
                wanted = batch.column(1)[a:b].to_pylist()
                mine = pa.array([prints[d].tobytes() == wanted[d] for d in range(b - a)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(ptr, pa.int32()),
                                                                    pa.array(grams.view(np.int64)))],
                    names=["id", "grams"]).filter(mine)

    docs = documents.select(F.col("doc_id").cast("long").alias("own_id"), "text")
    return nodes.join(docs, F.col("own_id").eqNullSafe(F.col("doc_id"))).select("id", "fingerprint", "text").mapInArrow(
        task, "id long, grams array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    part, whole = threshold
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(whole * common >= part * (F.size("x") + F.size("y") - common)).select("a", "b")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component, with the components ``root_a``, ``root_b``."""
    return (pairs.join(roots.select(F.col("id").alias("a"), F.col("root").alias("root_a")), "a", "left")
            .join(roots.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b", "left")
            .select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))
            .where("root_a != root_b"))


def _first_links(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int], sure: int) -> DataFrame:
    """Confirmed candidate pairs that connect all that candidate pairs can connect."""
    one = pairs.groupBy("b").agg(F.min(F.when(F.col("agree") >= sure, F.col("a"))).alias("smallest"),
                                 F.max(F.struct("agree", (-F.col("a")).alias("a"))).alias("best"))
    first = one.select(F.explode(F.array_distinct(F.array("smallest", -F.col("best.a")))).alias("a"), "b").where(
        "a IS NOT NULL")
    linked = written(_confirmed(first, sets, threshold), "links")
    more = _between(pairs, components(linked))
    return linked.union(written(_confirmed(more, sets, threshold), "more-links"))


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many nodes have a shingle of each hash bucket (a table of fixed size): at least as many
    as have the shingle itself."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in W.frugal(batches):
            counts += np.bincount(_bucket(np.asarray(batch.column(0).flatten())), minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    rows = sets.select("grams").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS, np.int64)
    table[np.asarray(rows["bucket"])] = np.asarray(rows["n"])
    return table


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1)


def prefixes(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(key, id, n, place): each node of (id, grams) under the rarest of its n shingles, in one order
    of all shingles. Of sets that are similar enough, the first common shingle in this order is
    within the first n - least + 1 of both, where least is the fewest shingles in common. Shingles
    that no other node has are left out."""
    part, whole = threshold
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            if not batch.num_rows:
                continue
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
            grams = np.asarray(lists.flatten())
            node = np.repeat(np.arange(len(ids)), sizes)
            n = shared.value[_bucket(grams)]
            order = np.lexsort((grams, n, node))
            place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            listed = (place <= sizes[node] + (-part * sizes[node]) // whole) & (n[order] > 1)
            node = node[listed]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (grams[order][listed], ids[node], sizes[node], place[listed])],
                names=["key", "id", "n", "place"])

    return sets.select("id", "grams").mapInArrow(task, "key long, id long, n long, place long")


def _compared(few: dict, many: dict, threshold: tuple[int, int], least: int, best: bool) -> tuple:
    """Pairs (a, b) of two blocks of one shingle that may be similar enough: not in one component,
    with sizes and places that leave enough common shingles, and ``least`` agreeing sketch values.
    ``best``: only the most similar node for each node of ``few`` and component."""
    part, whole = threshold
    out = []
    for i in range(0, len(few["id"]), 256):
        f = {k: v[i:i + 256] for k, v in few.items()}
        after = np.minimum((f["n"] - f["place"])[:, None], many["n"] - many["place"])
        fits = (part + whole) * after >= part * (f["n"][:, None] + many["n"])
        x, y = np.nonzero(fits & (f["root"][:, None] != many["root"]))
        for j in range(0, len(x), 1 << 16):
            p, q = x[j:j + (1 << 16)], y[j:j + (1 << 16)]
            agree = _SAME[f["sketch"][p] ^ many["sketch"][q]].sum(axis=1, dtype=np.int32)
            ok = agree >= least
            out.append(np.stack([f["id"][p[ok]], many["id"][q[ok]], many["root"][q[ok]], agree[ok]]))
    a, b, root, agree = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    if best and len(a):
        order = np.lexsort((b, -agree, root, a))
        a, b, root = a[order], b[order], root[order]
        new = np.append(True, (a[1:] != a[:-1]) | (root[1:] != root[:-1]))
        a, b = a[new], b[new]
    return np.minimum(a, b), np.maximum(a, b)


_BLOCK = ["key", "x", "y", "many"]
_ROW = [*_BLOCK, "id", "root", "n", "place", "sketch"]


def _blocks(listed: DataFrame, sketches: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the blocks to compare: those of one (key, x, y), ``many`` 0 with ``many`` 1.

    Under each shingle, the nodes outside its commonest component meet all nodes. Both sides are
    dealt into blocks of about ``PART_NODES`` nodes.
    """
    rows = listed.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    keys = rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.sum("c").alias("nodes"), F.count("*").alias("roots"), F.max("c").alias("most"),
        F.max_by("root", F.struct("c", "root")).alias("common")).where("roots > 1").select(
        "key", "common", F.ceil(F.col("nodes") / PART_NODES).cast("int").alias("parts"),
        F.ceil((F.col("nodes") - F.col("most")) / PART_NODES).cast("int").alias("few_parts"))
    rows = rows.join(keys, "key").join(sketches, "id")

    def dealt(parts: str):
        return F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    few = rows.where("root != common").withColumn("x", dealt("few_parts")).withColumn("y", every("parts"))
    many = rows.withColumn("y", dealt("parts")).withColumn("x", every("few_parts"))
    return few.withColumn("many", F.lit(0)).select(_ROW).union(many.withColumn("many", F.lit(1)).select(_ROW))


def _missed(blocks: DataFrame, threshold: tuple[int, int], least: int, best: bool) -> DataFrame:
    """(a, b): pairs of different components to confirm, from the two blocks of each group."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def compared(table: pa.Table) -> pa.RecordBatch:
            value = {c: table[c].to_numpy() for c in _ROW[:-1]}
            value["sketch"] = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, HASHES // 2)
            new = np.append(True, (np.diff(value["key"]) != 0) | (np.diff(value["x"]) != 0) | (np.diff(value["y"]) != 0))
            starts = np.append(np.flatnonzero(new), len(new))
            firsts = np.append(0, np.cumsum(value["many"] == 0))
            found = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                m = s + int(firsts[e] - firsts[s])
                if s < m < e:
                    found.append(_compared({c: value[c][s:m] for c in _ROW[4:]},
                                           {c: value[c][m:e] for c in _ROW[4:]}, threshold, least, best))
            a, b = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            a, b = np.unique(np.stack([a, b]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in W.frugal(batches):
            if not batch.num_rows:
                continue
            ids = [batch.column(c).to_numpy() for c in range(3)]
            now = tuple(int(c[-1]) for c in ids)
            begin = int(np.flatnonzero((ids[0] == now[0]) & (ids[1] == now[1]) & (ids[2] == now[2]))[0])
            if held and (begin or last != now):
                yield compared(pa.Table.from_batches([*held, batch[:begin]]))
                held = []
            elif begin:
                yield compared(pa.Table.from_batches([batch[:begin]]))
            held.append(batch[begin:])
            last = now
        if held:
            yield compared(pa.Table.from_batches(held))

    return blocks.repartition("key", "x", "y").sortWithinPartitions(*_BLOCK).mapInArrow(
        task, "a long, b long").distinct()


def _late_links(nodes: DataFrame, crowded: DataFrame, sets: DataFrame, linked: DataFrame, threshold: tuple[int, int],
                least: int) -> DataFrame:
    """(id, root) of all linked nodes, with the links that neighbours have missed.

    First the most similar pairs of nodes and components are confirmed, so that groups come
    together, then all pairs that are still between two components.
    """
    roots = components(linked)
    listed = written(prefixes(sets.join(crowded, "id", "left_semi"), threshold), "prefixes")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _sketches(_minima(batch.column(1)))],
                                                 names=["id", "sketch"])

    sketches = written(nodes.join(crowded, "id", "left_semi").select("id", "signature").mapInArrow(
        sketched, "id long, sketch binary"), "sketches")
    for best in (True, False):
        missed = written(_missed(_blocks(listed, sketches, roots), threshold, least, best), "missed")
        more = written(_confirmed(missed, sets, threshold), "late-links")
        if more.limit(1).count():
            linked = linked.union(more)
            roots = components(linked)
    return roots


def classes(documents: DataFrame, size: int = 4, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id and class (one id for
    each component; null without words)."""
    rows = written(signatures(documents, size), "signatures")
    nodes = written(rows.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(
        F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")).select(
        F.monotonically_increasing_id().alias("id"), "fingerprint", "doc_id", "signature"), "nodes")
    least = least_agreement(*threshold)
    pairs, crowded = candidates(nodes, least)
    pairs, crowded = written(pairs, "pairs"), written(crowded, "crowded")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowded).distinct()
    sets = written(_sets(documents, nodes.join(paired, "id", "left_semi"), size), "sets")
    linked = _first_links(pairs, sets, threshold, int(HASHES * (threshold[0] / threshold[1] + 0.04)))
    roots = _late_links(nodes, crowded, sets, linked, threshold, least)
    nodes = nodes.drop("signature")
    named = nodes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "root").select("fingerprint", "component_id", F.col("root").alias("class"))
    some = rows.where("fingerprint IS NOT NULL").drop("signature").join(named, "fingerprint").select(
        "doc_id", "text_hash", "n_shingles", "component_id", "class")
    none = rows.where("fingerprint IS NULL").select("doc_id", "text_hash", "n_shingles",
                                                    F.col("doc_id").alias("component_id"),
                                                    F.lit(None).cast("long").alias("class"))
    return some.union(none)


def _kept():
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def near_duplicates(documents: DataFrame, size: int = 4, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return classes(documents, size, threshold).select("doc_id", "n_shingles", "component_id", _kept().alias("kept"))


def without_near_duplicates(documents: DataFrame, size: int = 5,
                            threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, one for each group of near duplicates (that of the smallest
    doc_id); documents without words all stay, repeated rows of one text once."""
    blank = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r"))) == 0
    kept = classes(documents, size, threshold).where(_kept() & F.col("class").isNotNull())
    names = documents.columns
    p = free_prefix("kept_", names)
    kept = kept.groupBy("class", F.col("doc_id").alias(p + "id"), F.col("text_hash").alias(p + "hash")).agg(
        F.count("*").alias(p + "rows"))
    kept = kept.groupBy("class").agg(F.min(F.struct(p + "hash", p + "rows", p + "id")).alias("k")).select("k.*")
    own = [quoted(c) for c in names]
    joined = documents.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(p + "id"))
                            & (F.xxhash64("text") == F.col(p + "hash"))).where(~blank)
    repeated = joined.where(F.col(p + "rows") > 1).dropDuplicates([p + "id", p + "hash"])
    return documents.where(blank).union(joined.where(F.col(p + "rows") == 1).select(own)).union(repeated.select(own))

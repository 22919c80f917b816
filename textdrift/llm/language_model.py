"""Operator 6, language-model scoring with a hierarchical Pitman-Yor model.

Tokens are the lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` of a text and one end token. The
model has a Pitman-Yor restaurant for each preceding token (the end token before the first one).
Their common parent is a restaurant of tokens, to which each of their tables sends a customer; its
base is a spelling model: nested restaurants of byte contexts that share their parents
(``pitman_yor``). Each table of a token in the parent sends the token's
spelling into the spelling restaurants, so that rare and unknown tokens get their share from how
they are spelt. All three levels are reseated in each Gibbs sweep: the pairs of a token and the one
before given the parent's probabilities, the parent given the spelling model, then the spelling.
After ``BURN`` sweeps, the predictive probabilities of ``SAMPLES`` samples are averaged.

A pair that occurs once has one table in every sample, so only pairs that occur twice or more
are reseated; of the others a sweep needs how many a context and a token have. Pairs are dealt to
buckets of about ``BUCKET_TOKENS`` tokens, by context, or by the pair where the context is one of the
``COMMON`` most frequent tokens (a fixed number, whose values are broadcast); so no frequent context
is a hot key. Slices of texts send their pairs to the buckets as packed columns, once to count
them and once, with the documents that use them, to score them; a bucket returns sums by document.
A bucket's pairs stay together, packed into one row. In a sweep it gets the probabilities of its
uncommon tokens and gives the tables of these; those of common contexts and tokens are added up as
columns, by ranges of codes.
The vocabulary and the pairs are distributed tables that grow with the corpus. The driver gets the
spelling counts (bounded, see ``pitman_yor``) and the values of ``COMMON`` tokens. Only a pair that is
itself in a large share of all documents makes its bucket larger, by a byte or so for each.

``score`` is over the training vocabulary and one unknown token, as the base score is: a token
that no training text has takes the probability of all unseen tokens together, one minus the
sum over the vocabulary. ``open_score`` takes the probability of its own spelling instead.

Defined results: a null, empty or blank text has only its end token; without training rows all
counts are 0; repeated rows are counted and scored each for itself; an empty table gives no rows; a
very long text is a slice of its own.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.llm import pitman_yor as P, words as W
from textdrift.llm.tables import forget, remainder, written

HELD_OUT_MODULO = 10
BURN, SAMPLES = 1, 3
COMMON = 1 << 17
SLICE_BYTES, PAIR_SLICE_BYTES = 8 << 20, 4 << 20
BUCKET_TOKENS = 1 << 20
_END_HASH = 0x7E57E4D0C0FFEE11
CODE_RANGE = 1 << 13
_PAIR, _TOKEN, _COMMON = 0, 1, 2
_SINGLES, _ALONE, _OPENED, _SENT = 0, 1, 2, 3
_TABLES, _VALUES, _TEXTS, _DOCUMENTS = 0, 1, 2, 3
_ROWS = "bucket long, kind long, slice long, packed binary"
_COUNTS = "kind long, bucket long, w long, n long, sent long, packed binary"


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[W.Words, np.ndarray]:
    found = W.find_words(data, offsets, W.SPACED, lower=True)
    return found, W.word_hashes(found)


def vocabulary(documents: DataFrame) -> DataFrame:
    """hash, token (empty: the end token), its counts in the training rows (n) and in all (uses), for
    every token of ``documents`` (text, held_out)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            data, offsets = W.text_bytes(batch.column(0))
            trains = ~np.asarray(batch.column(1))
            for a, b in W.slices(data, offsets, SLICE_BYTES):
                found, hashes = _tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                counts = np.bincount(inverse, trains[a:b][found.doc_of()], len(distinct)).astype(np.int64)
                uses = np.bincount(inverse, minlength=len(distinct))
                raw = found.data.tobytes()
                tokens = [raw[s:e] for s, e in zip(found.starts[first].tolist(), found.ends[first].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(distinct, np.uint64(_END_HASH)).view(np.int64)),
                     pa.array([*tokens, b""], pa.binary()), pa.array(np.append(counts, trains[a:b].sum())),
                     pa.array(np.append(uses, b - a))], names=["hash", "token", "n", "uses"])

    return documents.mapInArrow(task, "hash long, token binary, n long, uses long").groupBy("hash", "token").agg(
        F.sum("n").alias("n"), F.sum("uses").alias("uses"))


class Codes:
    """Codes of tokens: the place among the ``COMMON`` most used tokens (in order of their hashes),
    or the hash with its highest bit set, which makes it negative; and the common tokens' counts."""

    def __init__(self, tokens: DataFrame):
        common = tokens.select("hash", "n", "uses").orderBy(F.desc("uses"), "hash").limit(COMMON).toPandas()
        common = common.sort_values("hash")
        self.hashes, self.counts = common["hash"].to_numpy(np.int64), common["n"].to_numpy(np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self) - 1, 0))
        hit = self.hashes[at] == hashes if len(self) else np.zeros(len(hashes), dtype=bool)
        return np.where(hit, at, hashes | np.int64(-1 << 63))

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """What random numbers depend on: the hashes, whichever tokens are common."""
        if not len(self):
            return codes
        return np.where(codes >= 0, self.hashes[np.maximum(codes, 0)] | np.int64(-1 << 63), codes)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns as one compressed string, byte by byte of all their numbers."""
    raw = np.array([len(c) for c in columns], np.int32).tobytes() + b"".join(
        np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes, *types: type) -> list[np.ndarray]:
    raw = pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), "zstd", asbytes=True)
    sizes = np.frombuffer(raw, np.int32, len(types))
    out, at = [], 4 * len(types)
    for n, kind in zip(sizes.tolist(), types):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def _deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.int64(0))


_TEXT_TYPES = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)
_PAIR_TYPES = (np.int64,) * 6


def _sent(found: W.Words, hashes: np.ndarray, trains: np.ndarray, codes: Codes, buckets: int,
          with_documents: bool) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed pairs) of a slice: the contexts' codes, tokens' codes and training counts of
    its pairs, how many documents use each, and these with their numbers of uses."""
    size = len(found.ptr) - 1
    distinct, local = np.unique(codes.of(np.append(hashes, np.uint64(_END_HASH))), return_inverse=True)
    end = local[-1]
    token = np.insert(local[:-1], found.ptr[1:], end)
    doc = np.insert(found.doc_of(), found.ptr[1:], np.arange(size))
    before = np.append(end, token[:-1])       # the token before a text's first one is an end token
    key = before.astype(np.int64) << 32 | token
    u = distinct[before]
    spread = np.where(u >= 0, _pair_hashes(u, distinct[token]), W.mix(u.view(np.uint64)))
    bucket = (spread % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    key, bucket, doc = key[order], bucket[order], doc[order]
    new_pair = np.append(True, key[1:] != key[:-1])
    new_use = new_pair | np.append(True, doc[1:] != doc[:-1])
    pair_at, use_at = np.flatnonzero(new_pair), np.flatnonzero(new_use)
    times = np.diff(np.append(use_at, len(key)))
    used_by = doc[use_at]
    pair_use = np.searchsorted(use_at, pair_at)
    documents = np.diff(np.append(pair_use, len(use_at)))
    n = np.add.reduceat(times * trains[used_by], pair_use)
    u, w, bucket = distinct[key[pair_at] >> 32], distinct[key[pair_at] & 0xFFFFFFFF], bucket[pair_at]
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
    use_ends, first, first_use = np.append(pair_use, len(use_at))[ends], 0, 0
    for last, last_use in zip(ends.tolist(), use_ends.tolist()):
        uses = (documents[first:last], used_by[first_use:last_use], times[first_use:last_use])
        if not with_documents:
            uses = (uses[0][:0],) * 3
        yield int(bucket[first]), _packed(_deltas(u[first:last]), w[first:last],
                                          *(c.astype(np.int32) for c in (n[first:last], *uses)))
        first, first_use = last, last_use


def _pair_hashes(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(before.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + token.view(np.uint64))


def _distinct(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens) of the distinct pairs in order, and the place of each given pair there."""
    order = np.lexsort((w, u))
    us, ws = u[order], w[order]
    new = np.append(True, (us[1:] != us[:-1]) | (ws[1:] != ws[:-1])) if len(u) else np.zeros(0, dtype=bool)
    inverse = np.empty(len(u), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return us[new], ws[new], inverse


def _packed_rows(rows: DataFrame, kind: int, number: type) -> DataFrame:
    """Rows (bucket, u, w, v: a list of numbers) as packed columns for each bucket of a batch."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, u, w = (np.asarray(batch.column(c)) for c in range(3))
            v = np.asarray(batch.column(3).flatten()).astype(number).reshape(len(w), -1)
            order = np.lexsort((w, u, bucket))
            bucket, u, w, v = bucket[order], u[order], w[order], v[order]
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            packed = [_packed(_deltas(u[a:b]), w[a:b], v[a:b].reshape(-1)) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edges[:-1]]), pa.array(np.full(len(packed), kind)), pa.nulls(len(packed), pa.int64()),
                 pa.array(packed, pa.binary())], names=["bucket", "kind", "slice", "packed"])

    return rows.select("bucket", "u", "w", "v").mapInArrow(task, _ROWS)


def _rows_of(packed: pa.ChunkedArray, number: type, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns u, w and v of such rows."""
    parts = [_unpacked(p, np.int64, np.int64, number) for p in packed.to_pylist()]
    none = [np.zeros(0, np.int64)]
    return (np.concatenate([np.cumsum(p[0]) for p in parts] or none), np.concatenate([p[1] for p in parts] or none),
            np.concatenate([p[2] for p in parts] or none).reshape(-1, width).astype(float))


def _starts(ascending: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    if not len(ascending):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1]))


def _kept(packed: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, training counts, tables in each kept sample) of packed pairs."""
    parts = [_unpacked(p, *_PAIR_TYPES) for p in packed.to_pylist()]
    none = [np.zeros(0, np.int64)]
    return (np.concatenate([np.cumsum(p[0]) for p in parts] or none), np.concatenate([p[1] for p in parts] or none),
            np.concatenate([p[2] for p in parts] or none),
            np.concatenate([p[5].reshape(SAMPLES, len(p[1])).T for p in parts] or [np.zeros((0, SAMPLES), np.int64)]))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of the runs of equal values in the first column."""
    key, parts = None, []
    for batch in batches:
        keys = np.asarray(batch.column(0))
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                if parts and keys[a] != key:
                    yield key, pa.Table.from_batches(parts)
                    parts = []
                key = int(keys[a])
                parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts)


def _counts(kind: int, bucket, w, n, sent, packed=None) -> pa.RecordBatch:
    size = len(w)
    columns = [np.broadcast_to(np.asarray(c, np.int64), size) for c in (kind, bucket, w, n, sent)]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c) for c in columns), pa.nulls(size, pa.binary()) if packed is None else pa.array(packed, pa.binary())],
        names=["kind", "bucket", "w", "n", "sent", "packed"])


def _common_rows(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums over common codes, a row for each of ``totals`` and range of codes."""
    for which, total in enumerate(totals):
        parts = [(i // CODE_RANGE, total[i:i + CODE_RANGE]) for i in range(0, len(total), CODE_RANGE)]
        parts = [(part, _packed(values)) for part, values in parts if values.any()]
        yield _counts(_COMMON, [part for part, _ in parts], np.full(len(parts), which), 0, 0, [x for _, x in parts])


def _common_sums(rows: DataFrame, size: int) -> np.ndarray:
    """The sums of all tasks: _SINGLES and _OPENED by common context, _ALONE and _SENT by common token."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns)):
                totals[key[:2]] = totals.get(key[:2], 0) + _unpacked(key[2], np.int64)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part for part, _ in totals], pa.int64()), pa.array([which for _, which in totals], pa.int64()),
             pa.array([_packed(x) for x in totals.values()], pa.binary())], names=["bucket", "w", "packed"])

    out = np.zeros((4, size), np.int64)
    for part, which, packed in rows.where(F.col("kind") == _COMMON).select("bucket", "w", "packed").repartition(
            "bucket").mapInArrow(add, "bucket long, w long, packed binary").collect():
        values = _unpacked(bytes(packed), np.int64)[0]
        out[which, part * CODE_RANGE:part * CODE_RANGE + len(values)] = values
    return out


def restaurants(documents: DataFrame, codes, buckets: int) -> DataFrame:
    """kind, bucket, w, n, sent, packed from the training counts of all pairs of ``documents`` (text,
    held_out). A _PAIR row has a bucket's pairs that occur twice or more, packed: contexts, tokens,
    training counts, of each context how many of its pairs occur once, tables (one each), and the
    tables of kept samples (none yet); n is how many occur exactly twice, sent how many once. A _TOKEN
    row says of a token that is not common and occurs in the bucket at all how many of its pairs
    occur once (n) and twice or more (sent). _COMMON rows are sums over common codes."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            data, offsets = W.text_bytes(batch.column(0))
            trains = ~np.asarray(batch.column(1))
            for a, b in W.slices(data, offsets, PAIR_SLICE_BYTES):
                sent = list(_sent(*_tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), trains[a:b],
                                  codes.value, buckets, False))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sent], pa.int64()),
                                                  pa.array([p for _, p in sent], pa.binary())], names=["bucket", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((4, len(codes.value)), np.int64)
        for bucket, rows in _by_key(W.frugal(batches)):
            parts = [_unpacked(p, *_TEXT_TYPES)[:3] for p in rows.column(1).to_pylist()]
            u, w, inverse = _distinct(np.concatenate([np.cumsum(p[0]) for p in parts]),
                                      np.concatenate([p[1] for p in parts]))
            n = np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(u)).astype(np.int64)
            many, once = n >= 2, n == 1
            contexts, at = np.unique(u, return_inverse=True)
            singles, opened = (np.bincount(at, x, len(contexts)).astype(np.int64) for x in (once, many))
            tokens, at = np.unique(w, return_inverse=True)
            alone, sent = (np.bincount(at, x, len(tokens)).astype(np.int64) for x in (once, many))
            for keys, which in ((contexts, ((_SINGLES, singles), (_OPENED, opened))),
                                (tokens, ((_ALONE, alone), (_SENT, sent)))):
                common = keys >= 0
                for k, values in which:
                    totals[k, keys[common]] += values[common]
            shared_by = singles[np.searchsorted(contexts, u[many][_starts(u[many])])]
            yield _counts(_PAIR, bucket, np.zeros(1, np.int64), int((n == 2).sum()), int(once.sum()), [_packed(
                _deltas(u[many]), w[many], n[many], shared_by, np.ones(int(many.sum()), np.int64), np.zeros(0, np.int64))])
            rare = tokens < 0
            yield _counts(_TOKEN, bucket, tokens[rare], alone[rare], sent[rare])
        yield from _common_rows(totals)

    return documents.mapInArrow(send, "bucket long, packed binary").repartition("bucket").sortWithinPartitions(
        "bucket").mapInArrow(count, _COUNTS)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Sample:
    """One Gibbs sample: the spelling model, the tables of all tokens, and the restaurant's values.

    The spelling table is kept compressed until it is used, since contexts without customers
    repeat their parent's rows: what is broadcast is far smaller than the table.
    """

    def __init__(self, spelling: P.Spelling, tables: float, customers: float, discount: float):
        self.packed = zlib.compress(spelling.logs.tobytes(), 1)
        self.tables, self.customers, self.discount = tables, customers, discount

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "logs"}

    @cached_property
    def logs(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.packed), np.float32)

    def spelt(self, cells: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        return np.exp(np.bincount(word, self.logs[cells], n))

    def seat(self, hashes: np.ndarray, counts: np.ndarray, spelt: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of each token in the sweep after this sample."""
        weight = (P.STRENGTH + self.discount * self.tables) * spelt
        return P.seat_any(counts, weight, self.discount, hashes.view(np.uint64), sweep)


def _sweep(tokens: DataFrame, codes, shared, sweep: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(spelling cells, their customers, number of tables) of a sweep given the sample before."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = np.asarray(batch.column(2))
            cells, word = P.spell(*_binary(batch.column(1)))
            if shared is None:
                tables = (counts > 0).astype(float)
            else:
                sample = shared.value
                keys = codes.value.keys(np.asarray(batch.column(0)))
                tables = sample.seat(keys, counts, sample.spelt(cells, word, len(counts)), sweep)
            distinct, inverse = np.unique(cells, return_inverse=True)
            customers = np.bincount(inverse, tables[word], len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(distinct, -1)),
                                              pa.array(np.append(customers, tables.sum()))], names=["cell", "n"])

    rows = tokens.mapInArrow(task, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    rows = rows.sort_values("cell")
    tables = float(rows.loc[rows["cell"] == -1, "n"].sum())
    rows = rows[(rows["cell"] >= 0) & (rows["n"] > 0)]
    return rows["cell"].to_numpy(np.int64), rows["n"].to_numpy(), tables


def _with_probability(parent: DataFrame, codes, before, now, sweep: int) -> DataFrame:
    """``parent`` (code, token, customers, n, alone, ps) with p, the predictive probability in the
    sample ``now``, in which the tables follow from the sample ``before``."""
    columns = [*parent.columns, "p"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, p = np.asarray(batch.column(2)), np.zeros(0)
            if len(counts):
                cells, word = P.spell(*_binary(batch.column(1)))
                sample, tables = now.value, (counts > 0).astype(float)
                if before is not None:
                    spelt = before.value.spelt(cells, word, len(counts))
                    tables = before.value.seat(codes.value.keys(np.asarray(batch.column(0))), counts, spelt, sweep)
                spelt = sample.spelt(cells, word, len(counts))
                p = np.maximum((counts - sample.discount * tables + (P.STRENGTH + sample.discount * sample.tables) * spelt)
                               / (P.STRENGTH + sample.customers), 1e-300)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=columns)

    return parent.mapInArrow(task, "code long, token binary, customers long, n long, alone long, ps array<float>, p double")


def _reseated(rows: DataFrame, probabilities: DataFrame, codes, common, discount: float, sweep: int) -> DataFrame:
    """``rows`` (as ``restaurants``) with the tables of this sweep, given each token's probability
    (``probabilities``: w, p) and what is ``common``: (tables opened in each common context,
    probability of each common token). A _TOKEN row's ``sent`` are the tables of its pairs."""
    places = rows.where((F.col("kind") == _TOKEN) & (F.col("sent") > 0)).select("bucket", "w")
    rare = places.join(probabilities.where("w < 0"), "w").select("bucket", F.lit(0).cast("long").alias("u"), "w",
                                                                 F.array("p").alias("v"))
    keep = sweep > BURN

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened_common, p_common = common.value
        totals = np.zeros((4, len(codes.value)), np.int64)
        for bucket, found in _by_key(W.frugal(batches)):
            kind = np.asarray(found.column("kind"))
            packed, values = (found.filter(pa.array(kind == k)).column("packed") for k in (_TABLES, _VALUES))
            deltas, w, n, singles, tables, kept = _unpacked(packed[0].as_py(), *_PAIR_TYPES)
            u = np.cumsum(deltas)
            starts = _starts(u)
            if not len(starts):
                yield _counts(_PAIR, bucket, np.zeros(1, np.int64), 0, 0, packed.to_pylist())
                continue
            contexts, sizes = u[starts], np.diff(np.append(starts, len(u)))
            at_common, is_common = contexts >= 0, w >= 0
            opened = np.add.reduceat(tables, starts) + singles
            opened[at_common] = opened_common[contexts[at_common]]
            _, tokens, delivered = _rows_of(values, np.float64, 1)
            order = np.argsort(tokens)
            p = np.empty(len(w))
            p[is_common] = p_common[w[is_common]]
            if not is_common.all():
                p[~is_common] = delivered[order, 0][_place(tokens[order], w[~is_common])]
            keys = _pair_hashes(codes.value.keys(u), codes.value.keys(w))
            weight = (P.STRENGTH + discount * np.repeat(opened, sizes)) * p
            tables = P.seat_any(n, weight, discount, keys, sweep).astype(np.int64)
            opened = np.add.reduceat(tables, starts)
            totals[_OPENED, contexts[at_common]] += opened[at_common]
            totals[_SENT] += np.bincount(w[is_common], tables[is_common], totals.shape[1]).astype(np.int64)
            yield _counts(_PAIR, bucket, np.zeros(1, np.int64), 0, 0, [_packed(
                deltas, w, n, singles, tables, np.append(kept, tables) if keep else kept)])
            tokens, at = np.unique(w[~is_common], return_inverse=True)
            yield _counts(_TOKEN, bucket, tokens, 0, np.bincount(at, tables[~is_common], len(tokens)).astype(np.int64))
        yield from _common_rows(totals)

    return _pair_rows(rows).unionAll(_packed_rows(rare, _VALUES, np.float64)).repartition("bucket").sortWithinPartitions(
        "bucket").mapInArrow(task, _COUNTS)


def _pair_rows(rows: DataFrame) -> DataFrame:
    """The packed pairs of such ``rows``, as rows for their buckets."""
    return rows.where(F.col("kind") == _PAIR).select("bucket", F.lit(_TABLES).cast("long").alias("kind"),
                                                     F.lit(None).cast("long").alias("slice"), "packed")


def _released(spark) -> None:
    """Lets Spark remove the shuffle files of jobs whose results are written: its cleaner acts when
    the driver's garbage collector has found that nothing refers to them. The driver's own freed
    memory goes back to the system, too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    W.trim()
    spark.sparkContext._jvm.System.gc()


class Model:
    """What training leaves: ``counts`` (as ``restaurants``), ``rows`` (the same after the last sweep, with
    the tables of each kept sample) and ``tokens`` (code, n and the probabilities of each kept sample)
    as written tables; the codes; the values of common contexts and tokens."""

    def __init__(self, documents: DataFrame):
        spark = documents.sparkSession
        tokens = written(vocabulary(documents), "vocabulary")
        total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0),
                           F.coalesce(F.sum("uses"), F.lit(0))).first()
        self.n, self.v, self.buckets = int(total[0]), int(total[1]), max(1, -(-int(total[2]) // BUCKET_TOKENS))
        codes = Codes(tokens)
        self.codes = spark.sparkContext.broadcast(codes)
        _released(spark)
        self.counts = written(restaurants(documents, self.codes, self.buckets), "word-pairs")
        _released(spark)
        self._sample(self._coded(tokens))
        forget(tokens)
        p = np.zeros((len(codes), SAMPLES))
        found = self.tokens.where("code >= 0").select("code", "ps").toArrow()
        if len(found):
            lists = [np.asarray(c.flatten()) for c in found.column(1).chunks]
            p[found.column(0).to_numpy()] = np.concatenate(lists).reshape(-1, SAMPLES)
        seen = self.tokens.where("n > 0").agg(*[F.sum(F.col("ps")[i]) for i in range(SAMPLES)]).first()
        self.unseen = np.maximum(1 - np.array([x or 0.0 for x in seen]), 1e-12)
        self.common = spark.sparkContext.broadcast((np.column_stack(self.opened).astype(float), p))

    def _coded(self, tokens: DataFrame) -> DataFrame:
        shared = self.codes

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.of(np.asarray(batch.column(0)))), *batch.columns[1:3]],
                                                 names=["code", "token", "n"])

        return tokens.select("hash", "token", "n").mapInArrow(task, "code long, token binary, n long")

    def _sample(self, tokens: DataFrame) -> None:
        """Gibbs sweeps over pairs, tokens and spellings."""
        spark, size = tokens.sparkSession, len(self.codes.value)
        self.rows = counts = self.counts
        exact, once = counts.where(F.col("kind") == _PAIR).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "sent")]).first()
        self.discount = float(np.clip(once / max(1, once + 2 * exact), 0.1, 0.9))
        sums = _common_sums(counts, size)
        singles, self.opened = sums[_SINGLES], []
        state = tokens.join(self._by_token("n", sums[_ALONE], "alone"), "code", "left").select(
            "code", "token", "n", F.coalesce("alone", F.lit(0)).alias("alone"), F.expr("cast(array() AS array<float>)").alias("ps"))
        spelling = before = now = probabilities = parent_discount = current = None
        for sweep in range(BURN + SAMPLES + 1):
            if sweep:
                found, p = current.where("code >= 0").select("code", "p").toArrow(), np.zeros(size)
                p[found.column(0).to_numpy()] = found.column(1).to_numpy()
                common = spark.sparkContext.broadcast((singles + sums[_OPENED], p))
                last, self.rows = self.rows, written(_reseated(
                    self.rows, probabilities, self.codes, common, self.discount, sweep), "word-tables")
                if sweep > 1:
                    forget(last)
                sums = _common_sums(self.rows, size)
            if sweep > BURN:
                self.opened.append(singles + sums[_OPENED])
            sent = self._by_token("sent", sums[_SENT], "sent")
            parent = written(state.join(sent, "code", "left").select(
                "code", "token", (F.col("alone") + F.coalesce("sent", F.lit(0))).alias("customers"), "n", "alone", "ps"),
                "customers")
            if current is not None:
                forget(current)
            seated = parent.agg(F.coalesce(F.sum("customers"), F.lit(0)), F.count_if(F.col("customers") == 1),
                                F.count_if(F.col("customers") == 2)).first()
            if parent_discount is None:
                parent_discount = float(np.clip(seated[1] / max(1, seated[1] + 2 * seated[2]), 0.1, 0.9))
            cells, tables_of, tables = _sweep(parent.select("code", "token", "customers"), self.codes, now, sweep)
            spelling = P.Spelling(cells, tables_of, spelling, sweep)
            before, now = now, spark.sparkContext.broadcast(Sample(spelling, tables, float(seated[0]), parent_discount))
            kept = F.concat("ps", F.array(F.col("p").cast("float"))) if sweep > BURN else F.col("ps")
            current = _with_probability(parent, self.codes, before, now, sweep).withColumn("ps", kept)
            if sweep < BURN + SAMPLES:
                current = written(current.drop("customers"), "tokens")
            else:
                self.tokens = written(current.select("code", "n", "ps"), "probabilities")
            spelling.logs = None
            forget(parent)
            probabilities, state = current.select(F.col("code").alias("w"), "p"), current.drop("p")
            _released(spark)

    def _by_token(self, column: str, common: np.ndarray, name: str) -> DataFrame:
        """code and the sum of ``column`` in the _TOKEN rows, or ``common`` of a common token."""
        spark = self.rows.sparkSession
        rare = self.rows.where((F.col("kind") == _TOKEN) & (F.col(column) > 0)).groupBy(F.col("w").alias("code")).agg(
            F.sum(column).alias(name))
        if not len(common):
            return rare
        return rare.unionAll(spark.createDataFrame(pa.table({"code": np.arange(len(common)), name: common})))

    @property
    def pairs(self) -> DataFrame:
        """u, w, n and the tables of each kept sample of the pairs that occur twice or more."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, w, n, kept = _kept(batch.column(0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * SAMPLES), pa.array(kept.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(n), lists], names=["u", "w", "n", "kept"])

        return self.rows.where(F.col("kind") == _PAIR).select("packed").mapInArrow(
            task, "u long, w long, n long, kept array<long>")


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))


def _bucket_sums(rows: pa.Table, model_common, codes: Codes, unseen: np.ndarray, discount: float,
                 base_of) -> Iterator[tuple[int, bytes]]:
    """(slice, packed sums by document) of a bucket's rows."""
    opened_common, p_common = model_common
    kind = np.asarray(rows.column("kind"))
    part = {k: rows.filter(pa.array(kind == k)) for k in (_TABLES, _VALUES, _TEXTS)}
    slices, texts = part[_TEXTS].column("slice").to_pylist(), part[_TEXTS].column("packed").to_pylist()
    if not texts:
        return
    heads = [_unpacked(p, *_TEXT_TYPES)[:3] for p in texts]
    sizes = np.cumsum([0, *(len(h[1]) for h in heads)])
    u, w, inverse = _distinct(np.concatenate([np.cumsum(h[0]) for h in heads]), np.concatenate([h[1] for h in heads]))
    n = np.bincount(inverse, np.concatenate([h[2] for h in heads]), len(u))
    # tables of the pairs in each sample: none, one, or as delivered
    tables = np.repeat((n > 0).astype(float)[:, None], SAMPLES, 1)
    tu, tw, _, delivered = _kept(part[_TABLES].column("packed"))
    if len(tu):
        # pairs of the two lists that are equal fall on the same place among all distinct ones
        places = _distinct(np.concatenate([u, tu]), np.concatenate([w, tw]))[2]
        tables[np.searchsorted(places[:len(u)], places[len(u):])] = delivered
    contexts, at = np.unique(u, return_inverse=True)
    opened = np.stack([np.bincount(at, tables[:, i], len(contexts)) for i in range(SAMPLES)], 1)
    served = np.bincount(at, n, len(contexts))
    common = contexts >= 0
    opened[common], served[common] = opened_common[contexts[common]], codes.counts[contexts[common]]
    opened, served = opened[at], served[at]
    rare_n, rare, rare_p = _rows_of(part[_VALUES].column("packed"), np.float32, SAMPLES)
    order = np.argsort(rare)
    rare, rare_n, rare_p = rare[order], rare_n[order], rare_p[order]
    p, token_n = np.empty((len(u), SAMPLES)), np.empty(len(u), np.int64)
    common = w >= 0
    p[common], token_n[common] = p_common[w[common]], codes.counts[w[common]]
    if not common.all():
        place = _place(rare, w[~common])
        p[~common], token_n[~common] = rare_p[place], rare_n[place]
    back = (P.STRENGTH + discount * opened) / (P.STRENGTH + served)[:, None]
    own = (n[:, None] - discount * tables) / (P.STRENGTH + served)[:, None]
    score = np.log10((own + back * np.where((token_n > 0)[:, None], p, unseen)).mean(axis=1))
    opens = np.log10((own + back * p).mean(axis=1))
    base, known = base_of(token_n), token_n > 0
    for slice_id, text, a, b in zip(slices, texts, sizes.tolist(), sizes[1:].tolist()):
        documents, used_by, times = _unpacked(text, *_TEXT_TYPES)[3:]
        pair = np.repeat(inverse[a:b], documents)
        docs, at = np.unique(used_by, return_inverse=True)
        sums = [np.bincount(at, times * x[pair], len(docs)) for x in (base, score, opens - score)]
        yield slice_id, _packed(_deltas(docs.astype(np.int64)).astype(np.int32), *sums,
                                np.bincount(at, times * known[pair], len(docs)).astype(np.int32))


def score(documents: DataFrame) -> DataFrame:
    """Scores of every document of (doc_id, text, held_out) by a model of those not held out."""
    model = Model(documents.select("text", "held_out"))
    codes, common, buckets, unseen, discount = model.codes, model.common, model.buckets, model.unseen, model.discount
    n, v = model.n, model.v

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            data, offsets = W.text_bytes(batch.column(1))
            trains, ids = ~np.asarray(batch.column(2)), np.asarray(batch.column(3))
            for a, b in W.slices(data, offsets, PAIR_SLICE_BYTES):
                found, hashes = _tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                sent = list(_sent(found, hashes, trains[a:b], codes.value, buckets, True))
                doc_id = batch.column(0)[a:b]
                about = _packed(np.asarray(doc_id.fill_null(0)), np.asarray(doc_id.is_null()).astype(np.uint8),
                                trains[a:b].astype(np.uint8), (found.counts + 1).astype(np.int64))
                keys = [k for k, _ in sent] + [int(ids[a]) % buckets]
                size = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([_TEXTS] * len(sent) + [_DOCUMENTS], pa.int64()),
                     pa.array(np.full(size, ids[a])), pa.array([*(x for _, x in sent), about], pa.binary())],
                    names=["bucket", "kind", "slice", "packed"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out",
                             F.monotonically_increasing_id().alias("row")).mapInArrow(send, _ROWS)
    tables = _pair_rows(model.rows)
    places = model.counts.where(F.col("kind") == _TOKEN).select("bucket", "w")
    rare = model.tokens.where("code < 0").select(F.col("code").alias("w"), F.col("n").alias("u"), F.col("ps").alias("v"))
    values = _packed_rows(places.join(rare, "w"), _VALUES, np.float32)

    def base_of(counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(W.frugal(batches)):
            found = list(_bucket_sums(rows, common.value, codes.value, unseen, discount, base_of))
            about = rows.filter(pa.compute.equal(rows.column("kind"), _DOCUMENTS))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*(k for k, _ in found), *about.column("slice").to_pylist()], pa.int64()),
                 pa.array([0] * len(found) + [1] * len(about), pa.int64()),
                 pa.array([*(x for _, x in found), *about.column("packed").to_pylist()], pa.binary())],
                names=["slice", "kind", "packed"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(W.frugal(batches)):
            about = rows.filter(pa.compute.equal(rows.column(1), 1)).column(2)[0].as_py()
            doc_id, null, trains, tokens = _unpacked(about, np.int64, np.uint8, np.uint8, np.int64)
            totals, known = np.zeros((3, len(doc_id))), np.zeros(len(doc_id), np.int64)
            for packed in rows.filter(pa.compute.equal(rows.column(1), 0)).column(2):
                docs, *parts, k = _unpacked(packed.as_py(), np.int32, np.float64, np.float64, np.float64, np.int32)
                docs = np.cumsum(docs)
                for total, x in zip(totals, parts):
                    total[docs] += x
                known[docs] += k
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, mask=null > 0), pa.array(trains == 0), pa.array(tokens), pa.array(known),
                 pa.array(np.full(len(doc_id), n, np.int64)), pa.array(totals[0]), pa.array(totals[1]),
                 pa.array(totals[1] + totals[2])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "open_score"])

    summed = texts.unionAll(tables).unionAll(values).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        sums, "slice long, kind long, packed binary")
    return summed.repartition("slice").sortWithinPartitions("slice").mapInArrow(
        gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                "score double, open_score double")


def score_corpus(documents: DataFrame, modulo: int = HELD_OUT_MODULO) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id) mod ``modulo`` is 0 are held out."""
    return score(documents.select("doc_id", "text", (remainder(F.col("doc_id"), modulo) == 0).alias("held_out")))

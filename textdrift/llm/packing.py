"""Operator 8, packing: cost-balanced packing of token sequences.

A document's cost is ``linear * n + quadratic * n^2`` (attention). Each task packs its documents
in groups of about ``group_tokens`` tokens: documents go, in descending cost, to the sequence of
the lowest cost so far that still has the room; a document longer than a sequence, or one that
fits nowhere, is cut. A group's sequences hold exactly its tokens: whole sequences of
``capacity`` tokens, and the rest in sequences whose lengths are powers of two, so that no
sequence needs padding. Nothing is shuffled; a group is bounded by its tokens.

Defined results: a null or empty text has only its end id; repeated rows are packed each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.llm import tokens, words as W

CAPACITY = 2048
GROUP_TOKENS = 1 << 20
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

_PIECES = "doc_id long, start long, length long, {} doc_tokens long, sequence_id long, offset long"


def capacities(total: int, capacity: int) -> np.ndarray:
    """Room of each sequence: full ones, then the rest in powers of two."""
    rest = total % capacity
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * (total // capacity) + powers, np.int64)


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float):
    """(document, start, length, sequence, offset) arrays of the pieces of one group."""
    room = capacities(int(lengths.sum()), capacity)
    left, cost = room.copy(), np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, size: int, at: int) -> None:
        out.append((doc, start, size, at, int(room[at] - left[at])))
        left[at] -= size
        cost[at] += linear * size + quadratic * size * size

    whole, rest, free = lengths // capacity, lengths % capacity, 0
    for doc in np.flatnonzero(whole).tolist():
        for k in range(int(whole[doc])):
            put(doc, k * capacity, capacity, free)
            free += 1
    for doc in np.argsort(-rest, kind="stable").tolist():
        start, size = int(whole[doc]) * capacity, int(rest[doc])
        while size:
            fits = left >= size
            open_ = fits if fits.any() else left > 0
            at = int(np.argmin(np.where(open_, cost, np.inf)))
            take = min(size, int(left[at]))
            put(doc, start, take, at)
            start, size = start + take, size - take
    return np.array(out, np.int64).reshape(-1, 5).T


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         group_tokens: int = GROUP_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC,
         with_ids: bool = True) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of ``capacity`` tokens.

    One row per piece: ``ids`` (or, without ``with_ids``, their ``ids_crc32``), where it starts in
    its document, and its sequence and offset there.
    """
    path = tokenizer or tokens.default_tokenizer()
    digest = ("ids", "array<int>") if with_ids else ("ids_crc32", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        context = TaskContext.get()
        base, given = (context.partitionId() if context else 0) << 32, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, size, given
            lengths = np.array([len(x) for x in held], np.int64)
            doc, start, length, sequence, offset = assign(lengths, capacity, linear, quadratic)
            pieces = [held[d][s:s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            told = (pa.array([p.tolist() for p in pieces], pa.list_(pa.int32())) if with_ids else
                    pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in pieces], pa.int64()))
            batch = pa.RecordBatch.from_arrays(
                [pa.array([keys[d] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(length), told,
                 pa.array(lengths[doc]), pa.array(base + given + sequence), pa.array(offset)],
                names=["doc_id", "start", "length", digest[0], "doc_tokens", "sequence_id", "offset"])
            given += int(sequence.max()) + 1 if len(sequence) else 0
            keys, held, size = [], [], 0
            return batch

        for batch in W.frugal(batches):
            ids = batch.column(0).to_pylist()
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(data, offsets, tokens.SLICE_BYTES):
                flat, counts = encoder.encode(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                bounds = np.concatenate([[0], np.cumsum(counts)])
                for d in range(b - a):
                    one = np.append(flat[bounds[d]:bounds[d + 1]], np.int32(end_id))
                    keys.append(ids[a + d])
                    held.append(one)
                    size += len(one)
                    if size >= group_tokens:
                        yield flush()
        if held:
            yield flush()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, _PIECES.format(f"{digest[0]} {digest[1]},"))

"""Vectorised words of Arrow string columns: byte spans, 64-bit word hashes, window hashes.

Every function works on whole texts. A batch is cut into slices of whole documents so that the
working arrays stay bounded (a longer single document makes a slice of its own). Word hashes
are polynomials of the word's bytes modulo 2^64, mixed at the end; equal words have equal
hashes, and callers that need exact equality compare the words themselves afterwards.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_CHUNK = 1 << 18
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def spaced_class() -> np.ndarray:
    """Byte table of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, dtype=bool)
    table[list(SPACES)] = False
    return table


def alnum_class() -> np.ndarray:
    """Byte table of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (A-Z already lower-cased)."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = True
    table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each one, freed memory goes back to the system, since a worker that waits
    for its next task keeps what it holds."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()
        trim()


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


SPACED, ALNUM, LOWER = spaced_class(), alnum_class(), lower_table()


@dataclass
class Words:
    """The words of some documents: ``data[starts[i]:ends[i]]``; document d has the words
    ``ptr[d]:ptr[d + 1]`` and the bytes ``offsets[d]:offsets[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc_of(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def text(self, first: int, last: int) -> list[bytes]:
        """The words first..last - 1 themselves."""
        raw = self.data[self.starts[first]:self.ends[last - 1]].tobytes() if last > first else b""
        base = self.starts[first] if last > first else 0
        return [raw[s:e] for s, e in zip((self.starts[first:last] - base).tolist(),
                                         (self.ends[first:last] - base).tolist())]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes, or of one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, wordclass: np.ndarray, lower: bool) -> Words:
    """All words of the documents; no word crosses a document's end."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = wordclass[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    starts = inside & ~before
    starts[edges] |= inside[edges]
    ends = before & ~inside
    edges = offsets[1:]
    ends[edges] |= before[edges]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    return Words(data, offsets, first, last, np.searchsorted(first, offsets))


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, _CHUNK + 4096)
        _powers, _inverses = np.full(n + 1, _R, np.uint64), np.full(n + 1, _R_INVERSE, np.uint64)
        _powers[0] = _inverses[0] = 1
        _powers, _inverses = np.cumprod(_powers), np.cumprod(_inverses)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: Words) -> np.ndarray:
    """One uint64 per word."""
    starts, ends = words.starts, words.ends
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(int(np.searchsorted(ends, starts[i] + _CHUNK, "right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        powers, inverses = _tables(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        part = words.data[a:b].astype(np.uint64)
        part += np.uint64(1)
        part *= powers[:b - a]
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * inverses[s]
        i = j
    return mix(out)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes (length n - k + 1), by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, power_len, block = hashes, 1, _Q          # block = _Q ** power_len
    total, total_len = None, 0
    rest = k
    while rest:
        if rest & 1:
            if total is None:
                total, total_len = power, power_len
            else:
                m = len(hashes) - total_len - power_len + 1
                total = total[:m] * block + power[total_len:total_len + m]
                total_len += power_len
        rest >>= 1
        if rest:
            m = len(hashes) - 2 * power_len + 1
            power = power[:m] * block + power[power_len:power_len + m]
            power_len *= 2
            block = block * block
    return mix(total[:n] + np.uint64(k))


def window_ends(words: Words, k: int) -> np.ndarray:
    """True for each word where k words of the same document start."""
    return np.arange(len(words.starts)) + k <= np.repeat(words.ptr[1:], words.counts)


np.seterr(over="ignore")

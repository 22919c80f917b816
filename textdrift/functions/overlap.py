"""Clipped n-gram matches and LCS of chain texts, vectorised over Arrow batches.

A batch of chains is handled in slices of bounded size; a T0 that several chains of a slice share
is tokenised once, and so is a word that a task meets again. Tokens are runs of code points found by
numpy (the classes of ``text.py``), hashed to 64 bits; the n-grams of an original are sorted, those of its
rewrites looked up among them, so that no n-gram becomes a Spark row or crosses the network. Only
counts leave the task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa

from textdrift.functions.lcs import lcs_of_codes

SLICE_CHARS = 2_000_000
STAGE_COLUMNS = ("T0", "T1", "T2", "T3")
KNOWN_WORDS = 300_000       # words, and characters in them, that a task remembers
KNOWN_CHARS = 20_000_000

_SPACES = {9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
           0x202F, 0x205F, 0x3000}
_UNKNOWN, _SPACE, _ALNUM, _MARK = 255, 0, 1, 2
_classes = np.full(0x110000, _UNKNOWN, np.uint8)
_BASE = 0x9E3779B97F4A7C15
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _classify(codes: np.ndarray) -> np.ndarray:
    found = _classes[codes]
    if (found == _UNKNOWN).any():
        for c in np.unique(codes[found == _UNKNOWN]).tolist():
            letter = unicodedata.category(chr(c))[0] in "LN"
            _classes[c] = _SPACE if c in _SPACES else _ALNUM if letter else _MARK
        found = _classes[codes]
    return found


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span; the place within the span is the exponent."""
    sizes = ends - starts
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = np.full(int(sizes.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    inside = codes[np.repeat(starts, sizes) + place].astype(np.uint64) + np.uint64(1)
    return _mix(np.add.reduceat(inside * powers[place], np.cumsum(sizes) - sizes))


class _Grams:
    """Token hashes of some texts, the text of each token, and the tokens of each text."""

    def __init__(self, hashes: np.ndarray, text: np.ndarray, n_texts: int):
        self.hashes, self.text, self.counts = hashes, text, np.bincount(text, minlength=n_texts)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n == 1:
            return self.hashes, self.text
        same = self.text[:-1] == self.text[1:]
        return (self.hashes[:-1] * _PAIR + self.hashes[1:])[same], self.text[:-1][same]


def _grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> _Grams:
    hashes = _span_hashes(codes, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return _Grams(hashes, np.searchsorted(offsets, starts, "right") - 1, len(offsets))


def tokenise(texts: list[str]) -> tuple[_Grams, _Grams]:
    """(BLEU tokens, ROUGE tokens) of lower-cased texts."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classify(codes)
    alnum, mark = kind == _ALNUM, kind == _MARK
    before = np.concatenate([[False], alnum[:-1]])
    starts = np.flatnonzero((alnum & ~before) | mark)
    after = np.concatenate([alnum[1:], [False]])
    ends = np.flatnonzero((alnum & ~after) | mark) + 1
    bleu = _grams(codes, starts, ends, offsets)
    plain = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    starts = np.flatnonzero(plain & ~np.concatenate([[False], plain[:-1]]))
    ends = np.flatnonzero(plain & ~np.concatenate([plain[1:], [False]])) + 1
    return bleu, _grams(codes, starts, ends, offsets)


class _Numbers(dict):
    """A number for each word, in order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Words:
    """Tokens of texts by way of their words: no token spans white space, so the tokens of a word are found
    once, at its first use, and looked up afterwards. Forgets all words when they are too many."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.chars = _Numbers(), 0
        # token hashes of all words one after the other, and the tokens of each word
        self.tokens = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]

    def tokenise(self, texts: list[str]) -> tuple[_Grams, _Grams]:
        """(BLEU tokens, ROUGE tokens) of lower-cased texts."""
        if len(self.numbers) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self._forget()
        before = len(self.numbers)
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        new = list(islice(self.numbers, before, None))
        if new:
            self.chars += sum(map(len, new))
            self.tokens = [(np.concatenate([hashes, g.hashes]), np.concatenate([counts, g.counts]))
                           for (hashes, counts), g in zip(self.tokens, tokenise(new))]
        owner = np.repeat(np.arange(len(texts)), sizes)
        out = []
        for hashes, counts in self.tokens:
            n = counts[numbers]
            shift = (np.cumsum(counts) - counts)[numbers] - (np.cumsum(n) - n)
            out.append(_Grams(hashes[np.repeat(shift, n) + np.arange(int(n.sum()))], np.repeat(owner, n), len(texts)))
        return out[0], out[1]


def _salt(text: np.ndarray) -> np.ndarray:
    return _mix(text.astype(np.uint64) + np.uint64(0x51ED270B))


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in the sorted distinct ``keys``, -1 if it is not there: by a table over the low
    bits, and by binary search where several keys share them."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    mask = np.uint64((1 << (8 * len(keys)).bit_length()) - 1)
    table = np.full(int(mask) + 1, -1, np.int32)
    table[keys & mask] = np.arange(len(keys), dtype=np.int32)
    at = table[wanted & mask].astype(np.int64)
    other = np.flatnonzero((at >= 0) & (keys[at] != wanted))
    again = np.minimum(np.searchsorted(keys, wanted[other]), len(keys) - 1)
    at[other] = np.where(keys[again] == wanted[other], again, -1)
    return at


def clipped_matches(grams: np.ndarray, text: np.ndarray, reference: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text, the sum over its grams of min(count in the text, count in its reference);
    ``reference[t]`` is -1 for texts that have none.

    Only the grams of references are sorted. A text has one cell for each distinct gram of its
    reference; its grams are looked up there and counted in their cells.
    """
    used = np.zeros(n_texts, bool)
    used[reference[reference >= 0]] = True
    ref = np.flatnonzero(used[text])
    keys, first, counts = np.unique(_mix(grams[ref] ^ _salt(text[ref])), return_index=True, return_counts=True)
    own = text[ref[first]]
    order = np.argsort(own, kind="stable")
    slot = np.empty(len(keys), np.int64)
    slot[order] = np.arange(len(keys))
    distinct = np.bincount(own, minlength=n_texts)      # by reference
    start = np.cumsum(distinct) - distinct
    cells = np.where(reference >= 0, distinct[reference], 0)
    base = np.cumsum(cells) - cells
    mine = np.flatnonzero(reference[text] >= 0)
    of = text[mine]
    at = _places(keys, _mix(grams[mine] ^ _salt(reference)[of]))
    hit = np.flatnonzero(at >= 0)
    shift = base - start[reference]
    found = np.bincount(slot[at[hit]] + shift[of[hit]], minlength=int(cells.sum()))
    owner = np.repeat(np.arange(n_texts), cells)
    limit = counts[order][np.arange(len(owner)) - shift[owner]]
    return np.bincount(owner, np.minimum(found, limit), n_texts).astype(np.int64)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + SLICE_CHARS, "right")), first + 1)
        yield first, last
        first = last


def _gram_kinds(metrics) -> list[str]:
    kinds = {"bleu": ("bleu1", "bleu2"), "rouge1": ("rouge1",), "rouge2": ("rouge2",)}
    return [k for m in ("bleu", "rouge1", "rouge2") if m in metrics for k in kinds[m]]


def count_columns(metrics) -> list[str]:
    """Names of the counts of one chain that ``metrics`` need, stage numbers 0 to 3 as suffix."""
    names = [f"has{i}" for i in range(4)] + [f"n_{k}{i}" for k in ("bleu", "rouge") for i in range(4)]
    names += [f"m_{k}{i}" for k in _gram_kinds(metrics) for i in (1, 2, 3)]
    return names + ([f"lcs{i}" for i in (1, 2, 3)] if "rougeL" in metrics else [])


def chain_counts(batch: pa.RecordBatch, metrics, words: Words) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(first row, last row, counts) of slices of a batch that ends with the columns T0..T3."""
    stages = [batch.column(batch.num_columns - 4 + i).to_pylist() for i in range(4)]
    sizes = np.array([sum(len(t) for t in row if t) for row in zip(*stages)], np.int64)
    for a, b in _slices(sizes):
        rows, texts, number = b - a, [], {}
        at = np.full((4, rows), -1, np.int64)
        for i in range(4):
            for r, t in enumerate(stages[i][a:b]):
                if t is None:
                    continue
                if i == 0 and t in number:
                    at[0, r] = number[t]
                    continue
                at[i, r] = len(texts)
                if i == 0:
                    number[t] = len(texts)
                texts.append(t)
        n = len(texts)
        grams = dict(zip(("bleu", "rouge"), words.tokenise(texts)))
        reference = np.full(n, -1, np.int64)
        for i in (1, 2, 3):
            reference[at[i][at[i] >= 0]] = at[0][at[i] >= 0]
        out = {f"has{i}": (at[i] >= 0).astype(np.int64) for i in range(4)}
        take = lambda values, i: np.where(at[i] >= 0, np.append(values, 0)[at[i]], 0)
        for kind, found in grams.items():
            out |= {f"n_{kind}{i}": take(found.counts, i) for i in range(4)}
        for kind in _gram_kinds(metrics):
            matches = clipped_matches(*grams[kind[:-1]].of(int(kind[-1])), reference, n)
            out |= {f"m_{kind}{i}": take(matches, i) for i in (1, 2, 3)}
        if "rougeL" in metrics:
            rouge = grams["rouge"]
            ptr = np.searchsorted(rouge.text, np.arange(n + 1))
            lists = [rouge.hashes[ptr[t]:ptr[t + 1]] for t in range(n)]
            length = np.array([lcs_of_codes(lists[reference[t]], lists[t]) if reference[t] >= 0 else 0
                               for t in range(n)], np.int64)
            out |= {f"lcs{i}": take(length, i) for i in (1, 2, 3)}
        yield a, b, out


np.seterr(over="ignore")

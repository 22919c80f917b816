"""Longest common subsequence length of token sequences.

LCS is a dynamic program with no built-in expression; ``overlap`` calls this on Arrow batches.
The bit-parallel formulation (Allison-Dix / Hyyro) takes one machine-word-parallel step per token
of the second sequence, so a pair costs O(|a| * |b| / 64) word operations instead of O(|a| * |b|)
cells.
"""

from __future__ import annotations

from itertools import repeat
from operator import contains

import numpy as np


def _masks(a):
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    return masks


def _lcs_with_masks(n: int, masks: dict, b) -> int:
    full = (1 << n) - 1
    v = full
    for tok in b:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - bin(v).count("1")


def lcs_length(a, b) -> int:
    """LCS length of two sequences (plain Python; also the brute-force check's partner)."""
    if a is None or b is None:
        return 0
    a = list(a)
    b = list(b)
    if not a or not b:
        return 0
    return _lcs_with_masks(len(a), _masks(a), b)


def lcs_of_codes(a: np.ndarray, b: np.ndarray) -> int:
    """LCS length of two arrays of token codes.

    Exact short cuts first: equal prefixes and suffixes, tokens that the other side lacks, and a
    side that is a subsequence of the other; the rest is bit-parallel.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    for known in (False, True):
        if known:       # only now, as it sorts both sides
            a, b = a[np.isin(a, b)], b[np.isin(b, a)]
        if not len(a) or not len(b):
            return head + tail
        x, y = (a.tolist(), b.tolist()) if len(a) >= len(b) else (b.tolist(), a.tolist())
        if all(map(contains, repeat(iter(x)), y)):
            return head + tail + len(y)
    return head + tail + _lcs_with_masks(len(x), _masks(x), y)

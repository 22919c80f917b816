"""Hierarchical Pitman-Yor restaurants in numpy: block Gibbs seating and the spelling model.

``seat`` reseats all customers of a dish at once: they enter one after the other and open a new
table with the Chinese-restaurant probability, given the other dishes' tables and the parent's
current probability of the dish. The first 32 customers enter singly, later ones in groups of a
sixteenth of those seated, whose new tables are a binomial draw.

``Spelling`` is a hierarchy over the bytes of words: the restaurant of the last three byte
classes shares as parent that of the last two, this that of the last one, and this the root,
whose base is uniform. With 32 classes and 257 symbols it has at most 32^3 * 257 = 8.4 million
cells (34 MB as a table of floats), whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from textdrift.llm import words as W

SYMBOLS, CLASSES, DEPTH = 257, 32, 3
END = 256
STRENGTH = 1.0


def _byte_classes() -> np.ndarray:
    """0: start of a word; 1-26: a-z; 27: digits; 28: other ASCII; 29-31: other bytes."""
    table = np.full(SYMBOLS, 28, np.int64)
    table[0x61:0x7B] = np.arange(1, 27)
    table[0x30:0x3A] = 27
    table[0x80:0x100] = 29 + np.arange(128) % 3
    table[END] = 0
    return table


BYTE_CLASSES = _byte_classes()


def hashed_uniforms(keys: np.ndarray, seed: int) -> Callable[[int, int], np.ndarray]:
    """uniforms(n, step): for the first n keys numbers in (0, 1) that depend on key, seed and step."""
    def uniforms(n: int, step: int) -> np.ndarray:
        salt = np.uint64((seed * 1_000_003 + step) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return ((W.mix(keys[:n] + salt) >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53
    return uniforms


def _binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial draws from uniforms: by inversion for small means, else the normal approximation."""
    mean = n * p
    large = mean > 8
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    out = np.where(large, np.rint(mean + z * np.sqrt(mean * (1 - p))), 0.0)
    odds = p / np.maximum(1 - p, 1e-12)
    mass = np.where(large, 1.0, np.maximum(1 - p, 1e-12) ** n)
    total, k = mass.copy(), 0
    todo = np.flatnonzero(~large & (u > total))
    while len(todo) and k < 64:
        mass[todo] *= (n[todo] - k) / (k + 1) * odds[todo]
        total[todo] += mass[todo]
        k += 1
        out[todo] = k
        todo = todo[(u[todo] > total[todo]) & (k < n[todo])]
    return np.clip(out, 0, n)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float,
         uniforms: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """Tables of each dish with so many customers; ``weight`` is a new table's weight. The dishes
    come in descending order of customers."""
    tables = (customers > 0).astype(float)
    seated, step = 1, 0
    ascending = customers[::-1]
    while True:
        n = len(customers) - int(np.searchsorted(ascending, seated, "right"))
        if not n:
            return tables
        group = np.minimum(max(1, seated // 16), customers[:n] - seated).astype(float)
        p = np.clip(weight[:n] / (weight[:n] + seated - discount * tables[:n]), 0.0, 1.0)
        tables[:n] += _binomial(group, p, uniforms(n, 2 * step), uniforms(n, 2 * step + 1))
        seated += max(1, seated // 16)
        step += 1


def seat_any(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray, seed: int) -> np.ndarray:
    """``seat`` for dishes in any order, with numbers that depend on ``keys`` and ``seed``."""
    order = np.argsort(-customers, kind="stable")
    out = np.empty(len(customers))
    out[order] = seat(customers[order], weight[order], discount, hashed_uniforms(keys[order], seed))
    return out


def discount_of(counts: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Discount from how many dishes were served once and twice."""
    one, two = ((counts == k) if weights is None else weights * (counts == k) for k in (1, 2))
    return float(np.clip(one.sum() / max(1.0, one.sum() + 2 * two.sum()), 0.1, 0.9))


class Spelling:
    """Predictive log probabilities ``logs[context * SYMBOLS + symbol]`` of one sample."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, previous: Spelling | None, seed: int):
        """Gibbs sweep: ``counts`` customers at the leaf ``cells``, reseated from the leaves to the
        root given the previous sample's probabilities, then new probabilities from the root."""
        self.levels: list[np.ndarray] = [np.zeros(0)] * (DEPTH + 1)
        seated = []
        for level in range(DEPTH, -1, -1):
            context, symbol = np.divmod(cells, SYMBOLS)
            parents = (context // CLASSES) * SYMBOLS + symbol
            base = (np.full(len(cells), 1 / SYMBOLS) if level == 0 or previous is None
                    else previous.levels[level - 1][parents])
            size = CLASSES ** level
            tables_before = np.bincount(context, minlength=size)      # at least one table for each dish
            discount = discount_of(counts)
            weight = (STRENGTH + discount * tables_before[context]) * base
            tables = seat_any(counts, weight, discount, cells.astype(np.uint64), seed * 8 + level)
            seated.append((cells, counts, tables, discount))
            cells, inverse = np.unique(parents, return_inverse=True)
            counts = np.bincount(inverse, tables, len(cells))
        below = np.full(SYMBOLS, 1 / SYMBOLS)
        for level, (cells, counts, tables, discount) in enumerate(reversed(seated)):
            size, context = CLASSES ** level, cells // SYMBOLS
            served = np.bincount(context, counts, size)
            opened = np.bincount(context, tables, size)
            back = ((STRENGTH + discount * opened) / (STRENGTH + served)).astype(np.float32)
            # the parent of context (.., c2, c1) with the last class highest is context // CLASSES
            table = below.reshape(-1, SYMBOLS)[np.arange(size) // CLASSES if level else [0]].astype(np.float32)
            table *= back[:, None]
            table = table.ravel()
            table[cells] += (counts - discount * tables) / (STRENGTH + served[context])
            self.levels[level] = below = table
        self.logs = np.log(self.levels[DEPTH]).astype(np.float32)


def spell(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of every symbol of every word, word of each): a word's bytes, then END."""
    sizes = np.diff(offsets) + 1
    word = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    symbols = np.full(int(ends[-1]) if len(ends) else 0, END, np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    inside[ends - 1] = False
    symbols[inside] = data
    place = np.arange(len(symbols)) - np.repeat(ends - sizes, sizes)
    classes = BYTE_CLASSES[symbols]
    context = np.zeros(len(symbols), np.int64)
    for back in range(1, DEPTH + 1):
        earlier = np.zeros(len(symbols), np.int64)
        earlier[back:] = classes[:-back]
        context = context * CLASSES + np.where(place >= back, earlier, 0)
    return context * SYMBOLS + symbols, word

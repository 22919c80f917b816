"""Token ids of whole texts by a public tokenizer, vectorised over Arrow batches.

The tokenizer (``word_bpe_49k.json``: lower case, white space dropped, byte-level BPE with word
ends) never merges across white space, nor across the border of an ASCII letter and an ASCII
mark other than the apostrophe. Texts are therefore cut there into units, each distinct unit is
encoded once by ``tokenizers``, and the ids are gathered by numpy. Workers keep a bounded cache
of encoded units. Tests compare the result with encoding the whole texts.
"""

from __future__ import annotations

import os
import re

import numpy as np

from textdrift.llm import words as W

TOKENIZER_FILE = "word_bpe_49k.json"
CACHE_UNITS = 600_000
SLICE_BYTES = 4 << 20
_JOINED = 2_000
_PLAIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")


def default_tokenizer() -> str:
    """Path of the public tokenizer file (a parameter of every operator here)."""
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER_FILE)


def find_units(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    """White-space separated chunks, cut again between ASCII letters and ASCII marks."""
    found = W.find_words(data, offsets, W.SPACED, lower=True)
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x30] = kind[0x3A:0x41] = kind[0x5B:0x61] = kind[0x7B:0x7F] = 2
    kind[0x27] = 0
    kind[0x61:0x7B] = 1
    kinds = kind[found.data]
    cuts = np.flatnonzero((kinds[:-1] ^ kinds[1:]) == 3) + 1
    cuts = cuts[~np.isin(cuts, offsets)]
    starts = np.sort(np.concatenate([found.starts, cuts]), kind="stable")
    ends = np.sort(np.concatenate([found.ends, cuts]), kind="stable")
    return W.Words(found.data, offsets, starts, ends, np.searchsorted(starts, offsets))


class Encoder:
    """Ids of texts; ``path`` names the tokenizer file."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.cache_units = cache_units
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.store = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _keep(self, units: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(units)
        while n + m > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        self.store[self.used:self.used + len(ids)] = ids
        self.size[n:n + m] = sizes
        self.at[n:n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(units, range(n, n + m)))

    def _learn(self, units: list[bytes]) -> None:
        texts = [u.decode("utf-8", "replace") for u in units]
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t)]
        for first in range(0, len(plain), _JOINED):
            part = plain[first:first + _JOINED]
            ids = np.array(self.tokenizer.encode(" ".join([texts[i] for i in part]),
                                                 add_special_tokens=False).ids, np.int32)
            last = np.flatnonzero(self.closes[ids])
            if len(last) == len(part):
                self._keep([units[i] for i in part], ids, np.diff(last, prepend=-1))
            else:
                self._learn_singly([units[i] for i in part], [texts[i] for i in part])
        done = set(plain)
        rest = [i for i in range(len(texts)) if i not in done]
        self._learn_singly([units[i] for i in rest], [texts[i] for i in rest])

    def _learn_singly(self, units: list[bytes], texts: list[str]) -> None:
        if units:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._keep(units, np.array([i for one in ids for i in one], np.int32),
                       np.array([len(one) for one in ids], np.int64))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, number of ids per document)."""
        units = find_units(data, offsets)
        if not len(units.starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        _, first, inverse = np.unique(W.word_hashes(units), return_index=True, return_inverse=True)
        raw = units.data.tobytes()
        distinct = [raw[s:e] for s, e in zip(units.starts[first].tolist(), units.ends[first].tolist())]
        if len(self.known) + len(distinct) > self.cache_units:
            self._reset()
        new = [u for u in distinct if u not in self.known]
        if new:
            self._learn(new)
        known = self.known
        number = np.array([known[u] for u in distinct], np.int64)[inverse]
        sizes = self.size[number]
        ends = np.cumsum(sizes)
        ids = self.store[np.repeat(self.at[number] - ends + sizes, sizes) + np.arange(ends[-1])]
        ends = np.concatenate([[0], ends])
        return ids, np.diff(ends[units.ptr])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

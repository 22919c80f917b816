"""Operator 2, benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The automaton accepts every run of words of every
item; a document's words are streamed through it, tracking the longest match that ends at each
word. Where it reaches a window's length, that window of an item occurs: a window is ``window``
consecutive words of an item, or a shorter item as a whole. All words inside an occurrence are
hit, and the items that own the window are noted.

Only words that may belong to a match are streamed: a numpy filter keeps the runs of words whose
every short gram (at most 4 words) has the hash of a gram of some item. It loses no occurrence,
and the automaton compares the words themselves.

Items are taken in shards of about ``shard_words`` words, so that an automaton (broadcast to the
tasks) has a bounded size. With one shard the documents are scanned once and never shuffled; with
several they are written once and scanned per shard, and only the hits are written for each.

Defined results: a null text, or one without words, has no words and no hits; an item without
words is ignored; repeated items count once per item_id (a null item_id counts as an empty one);
repeated document rows are judged each for itself; an empty item table hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.llm import words as W
from textdrift.llm.tables import free_prefix, mapped, quoted, written

WINDOW = 10
SHARD_WORDS = 200_000
GRAM = 4


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """State of the longest string of ``state`` followed by ``word``, split off if need be."""
        old = self.next[state][word]
        if self.length[old] == self.length[state] + 1:
            return old
        new = self._state(self.length[state] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            state = last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, word)
            last = new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest match after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def suffix(self, state: int, size: int) -> int:
        """State of the suffix of ``size`` words of a match that is at least so long."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state


class ItemIndex:
    """Automaton of some items, the items of every window, and the gram filter."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        self.grams: dict[int, list[np.ndarray]] = {}
        sequences = []
        for item, text in items:
            data, offsets = W.text_bytes(_array(text))
            found = W.find_words(data, offsets, W.ALNUM, lower=True)
            if not len(found.starts):
                continue
            words = [self.number.setdefault(w, len(self.number)) for w in found.text(0, len(found.starts))]
            sequences.append((item, words))
            gram = min(len(words), GRAM)
            self.grams.setdefault(gram, []).append(W.window_hashes(W.word_hashes(found), gram))
            self.automaton.add(words)
        self.grams = {g: np.unique(np.concatenate(h)) for g, h in self.grams.items()}
        self.sizes = sorted({min(len(words), window) for _, words in sequences}, reverse=True)
        self.owners: dict[tuple[int, int], set[str]] = {}
        for item, words in sequences:
            size = min(len(words), window)
            state = length = 0
            for word in words:
                state, length = self.automaton.step(state, length, word)
                if length >= size:
                    self.owners.setdefault((self.automaton.suffix(state, size), size), set()).add(item)
        self.filters = {g: self._bits(h) for g, h in self.grams.items()}
        self.seen: dict[tuple[int, int], tuple[int, frozenset[str]]] = {}

    @staticmethod
    def _bits(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return bits

    def _windows(self, state: int, length: int) -> tuple[int, frozenset[str]]:
        """(longest window that ends here, items of all windows that end here)."""
        key = (state, min(length, self.window))
        if key not in self.seen:
            longest, items = 0, set()
            for size in self.sizes:
                if length >= size:
                    owners = self.owners.get((self.automaton.suffix(state, size), size))
                    if owners:
                        longest = max(longest, size)
                        items |= owners
            self.seen[key] = (longest, frozenset(items))
        return self.seen[key]

    def runs(self, found: W.Words) -> Iterator[tuple[int, int]]:
        """Runs of words of one document in which a window may occur."""
        n = len(found.starts)
        covered = np.zeros(n + 1, np.int32)
        hashes = W.word_hashes(found)
        for gram, known in self.grams.items():
            h = W.window_hashes(hashes, gram)
            at = np.flatnonzero(self.filters[gram][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = at[W.window_ends(found, gram)[at]]
            near = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            at = at[known[near] == h[at]]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + gram, -1)
        inside = np.cumsum(covered)[:n] > 0
        edge = np.zeros(n + 1, dtype=bool)          # a document ends before this word
        edge[found.ptr] = True
        starts = np.flatnonzero(inside & (edge[:n] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        least = min(self.sizes, default=1)
        keep = ends - starts >= least
        return zip(starts[keep].tolist(), ends[keep].tolist())

    def hits(self, found: W.Words) -> tuple[list[tuple[int, int]], dict[int, set[str]]]:
        """(spans of hit words, items by the first word of the run they occur in)."""
        spans: list[tuple[int, int]] = []
        items: dict[int, set[str]] = {}
        if not self.sizes or not len(found.starts):
            return spans, items
        step, number = self.automaton.step, self.number
        for first, last in self.runs(found):
            state = length = 0
            for at, word in enumerate(found.text(first, last), first):
                state, length = step(state, length, number.get(word, -1))
                if length:
                    size, owners = self._windows(state, length)
                    if size:
                        spans.append((at + 1 - size, at + 1))
                        items.setdefault(first, set()).update(owners)
        return spans, items


def _array(text: str | None):
    return pa.array([text], pa.large_string())


def item_shards(items: DataFrame, shard_words: int) -> int:
    """Number of shards so that each has about ``shard_words`` words at most."""
    words = items.select(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-int(words) // (6 * shard_words)))


def _hits(index: ItemIndex, texts: pa.Array) -> tuple[list, list, list]:
    """For every text the starts and ends of its spans of hit words, and the sorted items found."""
    data, offsets = W.text_bytes(texts)
    starts, ends, owners = ([[] for _ in range(len(texts))] for _ in range(3))
    for a, b in W.slices(data, offsets):
        found = W.find_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], W.ALNUM, True)
        spans, items = index.hits(found)
        documents = np.searchsorted(found.ptr, [s for s, _ in spans], "right") - 1
        for d, (s, e) in zip(documents.tolist(), spans):
            base = int(found.ptr[d])
            s, e, at = s - base, e - base, a + d
            if ends[at] and starts[at][-1] <= s <= ends[at][-1]:
                ends[at][-1] = max(ends[at][-1], e)
            else:
                starts[at].append(s)
                ends[at].append(e)
        documents = np.searchsorted(found.ptr, list(items), "right") - 1
        for d, first in zip(documents.tolist(), items):
            owners[a + d] = sorted({*owners[a + d], *items[first]})
    return starts, ends, owners


def _with_hits(documents: DataFrame, items: DataFrame, window: int, shard_words: int, finish, schema) -> DataFrame:
    """``finish(batch, starts, ends, items)`` of every batch of ``documents``, whose column ``text`` is
    looked up in the items; the spans of a text may overlap.

    One shard of items needs one task, in which ``finish`` follows at once. With several shards, only
    the hits of each are written (row, spans, items), and joined with the rows at the end: the texts
    are written once, whatever the number of shards."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    shards = item_shards(items, shard_words)
    context, names = documents.sparkSession.sparkContext, documents.columns

    def index(shard: int):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard) if shards > 1 else items
        return context.broadcast(ItemIndex([(r.item_id, r.text) for r in part.toLocalIterator()], window))

    if shards == 1:
        shared = index(0)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.frugal(batches):
                yield finish(batch, *_hits(shared.value, batch.column("text")))

        return mapped(documents, task, schema)

    p = free_prefix("hit_", names)
    docs = written(documents.withColumn(p + "row", F.monotonically_increasing_id()), "decontamination")
    kinds = f"{p}row long, {p}starts array<int>, {p}ends array<int>, {p}items array<string>"

    def lookup(shared):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.frugal(batches):
                columns = _hits(shared.value, batch.column(1))
                out = [batch.column(0), *(pa.array(c, pa.list_(t)) for c, t in
                                          zip(columns, (pa.int32(), pa.int32(), pa.string())))]
                yield pa.RecordBatch.from_arrays(out, names=[p + c for c in ("row", "starts", "ends", "items")]).filter(
                    pa.array([bool(s) for s in columns[0]], pa.bool_()))
        return docs.select(p + "row", "text").mapInArrow(task, kinds)

    hits = None
    for shard in range(shards):
        some = written(lookup(index(shard)), "hits")
        hits = some if hits is None else hits.union(some)
    hits = hits.groupBy(p + "row").agg(*[F.flatten(F.collect_list(p + c)).alias(p + c) for c in ("starts", "ends")],
                                       F.array_sort(F.array_distinct(F.flatten(F.collect_list(p + "items")))).alias(p + "items"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            found = [[x or [] for x in column.to_pylist()] for column in batch.columns[len(names):]]
            yield finish(batch.select(list(range(len(names)))), *found)

    joined = docs.join(hits, p + "row", "left").select(
        *[quoted(c) for c in names], p + "starts", p + "ends", p + "items")
    return mapped(joined, task, schema)


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: how many of its words benchmark windows hit, and of which items."""
    def finish(batch: pa.RecordBatch, starts: list, ends: list, items: list) -> pa.RecordBatch:
        hit = [sum(e - s for s, e in _merged(a, b)) for a, b in zip(starts, ends)]
        names = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        data, offsets = W.text_bytes(batch.column("text"))
        counts = [W.find_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], W.ALNUM, True).counts
                  for a, b in W.slices(data, offsets)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate(counts) if counts else [], pa.int64()),
             pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(names, pa.string()),
             pa.array([h > 0 for h in hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_hits(docs, items, window, shard_words, finish, "doc_id long, n_words long, n_hit long, n_items long, "
                                                                "items_sha256 string, contaminated boolean")


def decontaminate(documents: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """``documents`` without the hit spans: a document of which more than ``max_coverage`` of the
    words are hit, or of which no word would be left, is dropped; of any other the bytes from the
    first to the last word of each span go. Untouched texts and other columns stay as they are."""
    def finish(batch: pa.RecordBatch, starts: list, ends: list, items: list) -> pa.RecordBatch:
        at_text = batch.schema.get_field_index("text")
        data, offsets = W.text_bytes(batch.column(at_text))
        texts, keep = batch.column(at_text).to_pylist(), np.ones(batch.num_rows, dtype=bool)
        for d, spans in enumerate(zip(starts, ends)):
            if not spans[0]:
                continue
            raw = data[offsets[d]:offsets[d + 1]]
            words = W.find_words(raw, np.array([0, len(raw)]), W.ALNUM, True)
            left, at, hit = [], 0, 0
            for a, b in _merged(*spans):
                left.append(raw[at:words.starts[a]].tobytes())
                at, hit = int(words.ends[b - 1]), hit + b - a
            texts[d] = b"".join([*left, raw[at:].tobytes()]).decode()
            keep[d] = hit < len(words.starts) and hit <= max_coverage * len(words.starts)
        columns = list(batch.columns)
        columns[at_text] = pa.array(texts, columns[at_text].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return _with_hits(documents, items, window, shard_words, finish, documents.schema)

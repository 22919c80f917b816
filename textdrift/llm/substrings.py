"""Operator 4, substring deduplication with repeated-phrase automata.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``window`` consecutive words of one
document; a window whose words also start anywhere else is repeated, and all words that repeated
windows cover are removed.

1. Equal texts are one text with a number of copies (a copied text is repeated as a whole). Each
   text gives its anchors: the minimizers of its windows, that is the smallest hash of the
   ``GRAM``-word grams in each window. Equal windows have equal anchors.
2. Texts with an anchor that recurs are the only ones that may hold repeated windows. Their
   windows with recurring anchors are counted by hash over the whole corpus: windows found twice
   or more are confirmed, and runs of them are the recurring passages.
3. The passages of a shard of texts are compiled into an Aho-Corasick automaton over word
   numbers (windows at every ``window`` words of a passage and at its end, which cover it), and
   all texts of the shard are streamed through it to locate every occurrence. Shards are slices
   of Arrow batches, so that an automaton is bounded.

Counts are combined before each shuffle, so that a passage shared by any share of the corpus
costs one row per task; hot join keys are split by Spark's skew join.

Defined results: null, empty and blank texts have no words and keep none; texts shorter than a
window are never repeated; repeated rows count as copies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.llm import words as W
from textdrift.llm.tables import free_prefix, quoted, written

WINDOW, GRAM = 35, 8
SHARD_BYTES = 1 << 20
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    reach, done = values, 1
    while 2 * done <= width:
        reach = pick(reach[:len(reach) - done], reach[done:])
        done *= 2
    rest = width - done
    return pick(reach[:len(reach) - rest], reach[rest:]) if rest else reach


class Windows:
    """Window and anchor arrays of a slice of documents."""

    def __init__(self, found: W.Words, window: int):
        self.found, self.window, self.reach = found, window, window - GRAM + 1
        self.hashes = W.word_hashes(found)
        self.grams = W.window_hashes(self.hashes, GRAM)
        self.least = _slide(self.grams, self.reach, np.minimum)
        self.valid = W.window_ends(found, window)[:len(self.least)]

    def anchors(self) -> np.ndarray:
        """Positions of the minimizers of all windows."""
        if not len(self.least):
            return np.zeros(0, np.int64)
        least = np.concatenate([np.zeros(self.reach - 1, np.uint64), np.where(self.valid, self.least, np.uint64(0)),
                                np.zeros(self.reach - 1, np.uint64)])
        return np.flatnonzero((_slide(least, self.reach, np.maximum)[:len(self.grams)] == self.grams)
                              & (self.grams > 0))

    def starting_at(self, recurring: np.ndarray) -> np.ndarray:
        """Starts of the windows whose minimizer is at one of the recurring positions."""
        grams = np.full(len(self.grams), _MAX)
        grams[recurring] = self.grams[recurring]
        return np.flatnonzero(self.valid & (_slide(grams, self.reach, np.minimum) == self.least))


def _per_doc(found: W.Words, at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, found.ptr), pa.int32()), pa.array(values, kind))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _texts(documents: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, n_words, digest of all words, anchor hashes and positions."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            data, offsets = W.text_bytes(batch.column(2))
            for a, b in W.slices(data, offsets):
                found = W.find_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], W.SPACED, False)
                windows = Windows(found, window)
                at = windows.anchors()
                place = at - found.ptr[np.searchsorted(found.ptr, at, "right") - 1]
                digests = [_digest(data[offsets[d]:offsets[d + 1]].tobytes().split()) for d in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(found.counts, pa.int64()),
                     pa.array(digests, pa.binary()), _per_doc(found, at, windows.grams[at].view(np.int64), pa.int64()),
                     _per_doc(found, at, place, pa.int32())],
                    names=["doc_id", "text_key", "n_words", "digest", "anchors", "places"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"),
                            "text").mapInArrow(task, "doc_id long, text_key binary, n_words long, digest binary, "
                                                     "anchors array<long>, places array<int>")


def _text_key():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _recurring(exploded: DataFrame, key: str) -> DataFrame:
    return exploded.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)


def _candidates(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text, places): each text with recurring anchors, and where they are."""
    anchors = texts.select("id", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select(
        F.col("x.anchors").alias("anchor"), "id", F.col("x.places").alias("place"))
    found = anchors.join(_recurring(anchors, "anchor"), "anchor").groupBy("id").agg(
        F.sort_array(F.collect_list("place")).alias("places"))
    found = found.join(texts.select("id", "text_key", F.col("doc_id").alias("own_id")), "id")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), "text")
    return docs.join(found, "text_key").where(F.col("doc_id").eqNullSafe(F.col("own_id"))).select(
        "id", "text", "places")


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """(window, id, start) of every window whose minimizer recurs."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            data, offsets = W.text_bytes(batch.column(1))
            places = batch.column(2)
            for a, b in W.slices(data, offsets):
                found = W.find_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], W.SPACED, False)
                some = places[a:b]
                flat = np.asarray(some.flatten()).astype(np.int64)
                sizes = np.asarray(pa.compute.list_value_length(some)).astype(np.int64)
                starts = Windows(found, window).starting_at(flat + np.repeat(found.ptr[:-1], sizes))
                doc = np.searchsorted(found.ptr, starts, "right") - 1
                hashes = W.window_hashes(W.word_hashes(found), window)[starts] if len(starts) else np.zeros(0, np.uint64)
                ids = np.asarray(batch.column(0)[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(ids[doc]),
                     pa.array((starts - found.ptr[doc]).astype(np.int32))], names=["window", "id", "start"])

    return candidates.mapInArrow(task, "window long, id long, start int")


def _locate(confirmed: DataFrame, window: int, with_text: bool) -> DataFrame:
    """(id, n_removed, digest of the kept words or the kept text) of texts with passages."""
    def kept(texts: list[bytes], starts: list[list[int]]) -> Iterator[tuple[int, list[bytes]]]:
        number: dict[bytes, int] = {}
        words = [t.split() for t in texts]
        coded = [tuple([number.setdefault(w, len(number)) for w in ws]) for ws in words]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for code, first in zip(coded, starts):
            previous = last = None
            for s in [*sorted(first), None]:            # a passage is a run of confirmed windows
                if previous is not None and s != previous + 1:
                    automaton.add_word(code[previous:previous + window], window)
                    last = None
                if s is not None and (last is None or s >= last + window):
                    automaton.add_word(code[s:s + window], window)
                    last = s
                previous = s
        automaton.make_automaton()
        for ws, code in zip(words, coded):
            keep, covered = [], 0
            for end, size in automaton.iter(code):
                start = end + 1 - size
                if start > covered:
                    keep.extend(ws[covered:start])
                covered = max(covered, end + 1)
            keep.extend(ws[covered:])
            yield len(ws) - len(keep), keep

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(data, offsets, SHARD_BYTES):
                found = list(kept([data[offsets[d]:offsets[d + 1]].tobytes() for d in range(a, b)],
                                  batch.column(2)[a:b].to_pylist()))
                out = (pa.array([b" ".join(k).decode() for _, k in found], pa.string()) if with_text
                       else pa.array([_digest(k) for _, k in found], pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([n for n, _ in found], pa.int64()), out],
                                                 names=["id", "n_removed", "kept"])

    return confirmed.mapInArrow(task, f"id long, n_removed long, kept {'string' if with_text else 'binary'}")


def _results(documents: DataFrame, window: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """(a row per document, a row per distinct text with repeated passages)."""
    rows = written(_texts(documents, window), "texts")
    texts = written(rows.where(f"n_words >= {window}").groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"),
        F.first(F.struct("anchors", "places")).alias("a")).select(
        F.monotonically_increasing_id().alias("id"), "text_key", "doc_id", "copies", "n_words", "a.*"), "distinct-texts")
    candidates = written(_candidates(documents, texts), "candidates")
    windows = _windows(candidates, window)
    starts = written(windows.join(_recurring(windows, "window"), "window").groupBy("id").agg(
        F.collect_set("start").alias("starts")), "passages")
    single = texts.where("copies = 1").select("id")
    located = _locate(candidates.select("id", "text").join(starts.join(single, "id", "left_semi"), "id")
                      .select("id", "text", "starts"), window, with_text)
    nothing = F.lit("") if with_text else F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    keys = texts.select("id", "text_key")
    passages = located.join(keys, "id").select("text_key", "n_removed", "kept").union(
        texts.where("copies > 1").select("text_key", F.col("n_words").alias("n_removed"), nothing.alias("kept")))
    return rows, written(passages, "removed")


def repeated_words(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) per document."""
    rows, removed = _results(documents, window, with_text=False)
    return rows.select("doc_id", "text_key", "n_words", "digest").join(removed, "text_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.coalesce("kept", "digest"))).alias("kept_sha256"))


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` with the repeated words taken out of the texts (the kept words of such a text
    are joined by one space; other texts stay as they are). All rows stay."""
    names = documents.columns
    prefix = free_prefix("removed_", names)
    _, removed = _results(documents, window, with_text=True)
    removed = removed.select(F.col("text_key").alias(prefix + "key"), F.col("kept").alias(prefix + "kept"))
    joined = documents.join(removed, _text_key() == F.col(prefix + "key"), "left")
    return joined.select(*[F.coalesce(prefix + "kept", "text").alias("text") if c == "text" else quoted(c)
                           for c in names])

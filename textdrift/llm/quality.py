"""Operator 1, quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a whole text are computed by numpy over the bytes and words of Arrow batches
(``FEATURES``): length, word, line, letter-case, digit and mark ratios, and how often words and
word runs repeat. They use neither labels nor lang, source or doc_id.

Training takes at most about ``SAMPLE`` labelled rows, chosen by a hash of doc_id (a documented
bound); only their statistics reach the driver, which fits the trees (``boosting``). The flat
arrays of the trees are broadcast (their size is fixed by ``boosting``) and all rows are scored.

Defined results: null and empty texts have all statistics 0 and get the trees' score for that;
without labelled rows of both classes every score is 0.5; rows with a null label do not train;
a doc_id with several labels trains with each; repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.llm import boosting, words as W
from textdrift.llm.tables import mapped, remainder

SAMPLE = 12_000
THRESHOLD = 0.3

_KINDS = {"digit": b"0123456789", "stop": b".,;:?", "bang": b"!", "symbol": b"#*$%&|<>=+~^_@/\\{}[]()",
          "newline": b"\n", "upper": bytes(range(0x41, 0x5B)), "lower": bytes(range(0x61, 0x7B)),
          "high": bytes(range(0x80, 0x100)), "quote": b"\"'`"}
FEATURES = ["log_bytes", "log_words", *(f"{k}_share" for k in _KINDS), "word_length", "word_length_deviation",
            "longest_word", "line_length", "distinct_words", "repeated_pairs", "repeated_fives", "same_as_last",
            "top_word", "lines_repeated", "sentence_length", "short_words", "capital_words", "plain_words",
            "marked_words"]


def _runs_per_doc(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the commonest key) per document."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, d[at], np.diff(at, append=len(k)))
    return np.bincount(d[at], minlength=n).astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    kind = np.zeros(256, np.uint8)
    for i, chars in enumerate(_KINDS.values(), 1):
        kind[list(chars)] = i
    doc_of_byte = np.repeat(np.arange(n) * 16, np.diff(offsets))
    counts = np.bincount(doc_of_byte + kind[data], minlength=16 * n).reshape(n, 16)[:, 1:len(_KINDS) + 1]
    found = W.find_words(data, offsets, W.SPACED, lower=False)
    hashes, doc, words = W.word_hashes(found), found.doc_of(), found.counts.astype(float)
    many = np.maximum(words, 1)
    length = (found.ends - found.starts).astype(float)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, n) / many

    average = mean(length)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    distinct, top = _runs_per_doc(hashes, doc, n)
    repeated = []
    for k in (2, 5):
        h = W.window_hashes(hashes, k)
        ok = W.window_ends(found, k)[:len(h)]
        d = doc[:len(h)][ok]
        different, _ = _runs_per_doc(h[ok], d, n)
        total = np.bincount(d, minlength=n)
        repeated.append(1 - different / np.maximum(total, 1) * (total > 0) - (total == 0))
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    lines = W.find_words(data, offsets, _LINE, lower=False)
    line_doc, line_count = lines.doc_of(), np.maximum(lines.counts, 1)
    line_distinct, _ = _runs_per_doc(W.word_hashes(lines), line_doc, n)
    last = found.data[found.ends - 1] if len(found.ends) else np.zeros(0, np.uint8)
    first = found.data[found.starts] if len(found.starts) else np.zeros(0, np.uint8)
    ends = mean(np.isin(last, list(b".!?")).astype(float))
    letters = np.zeros(256, dtype=np.int64)
    letters[0x41:0x5B] = letters[0x61:0x7B] = letters[0x80:] = 1
    in_words = np.concatenate([[0], np.cumsum(letters[data])])
    alphabetic = in_words[found.ends] - in_words[found.starts]
    columns = [np.log1p(size), np.log1p(words), *(counts / some[:, None]).T, average,
               np.sqrt(np.maximum(mean(length ** 2) - average ** 2, 0)), np.log1p(longest),
               np.log1p(size / line_count), distinct / many, *repeated, mean(same), top / many,
               1 - line_distinct / line_count * (lines.counts > 0) - (lines.counts == 0), ends,
               mean((length <= 3).astype(float)), mean(((first >= 0x41) & (first < 0x5B)).astype(float)),
               mean((alphabetic == length).astype(float)), mean((alphabetic == 0).astype(float))]
    return np.stack(columns, axis=1)


_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False


def _batch_statistics(column: pa.Array) -> np.ndarray:
    data, offsets = W.text_bytes(column)
    parts = [statistics(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in W.slices(data, offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Forest | None:
    """Trees from the labelled rows that are not held out; None if they lack a class."""
    known = labels.where(F.col("quality").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).select(
        F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    total = known.count()
    part = int(min(1.0, sample / max(total, 1)) * 1_000_000)
    known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < part)
    rows = documents.select(F.col("doc_id"), "text").join(known, F.col("doc_id") == F.col("label_id")).select(
        "doc_id", "text", "quality")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            x = _batch_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2),
                 pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))],
                names=["doc_id", "quality", "x"])

    got = sorted((r.doc_id, r.quality, list(r.x)) for r in
                 rows.mapInArrow(task, "doc_id long, quality int, x array<double>").collect())
    y = np.array([q for _, q, _ in got])
    return boosting.fit(np.array([x for *_, x in got]), y) if len(set(y.tolist())) == 2 else None


def score(documents: DataFrame, forest: boosting.Forest | None, keep_rows: bool = False) -> DataFrame:
    """The score of every whole text: (doc_id, held_out, score, predicted), or, with
    ``keep_rows``, the rows of ``documents`` that are not rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(forest)

    def scores(column: pa.Array) -> np.ndarray:
        x = _batch_statistics(column)
        return shared.value.score(x) if shared.value is not None else np.full(len(x), 0.5)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            s = scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s),
                                              pa.array((s >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            yield batch.filter(pa.array(scores(batch.column("text")) >= THRESHOLD))

    if keep_rows:
        return mapped(documents, kept, documents.schema)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                            (remainder(F.col("doc_id"), 5) == 0).alias("held_out")).mapInArrow(
        task, "doc_id long, held_out boolean, score double, predicted int")

"""Operator 9, language identification with a byte convolutional network trained in numpy.

A text's bytes are cut into windows of ``WIDTH`` bytes. Each byte class has an embedding; filters
of widths 2, 3 and 4 run over a window, are rectified and max-pooled, and a softmax layer gives
the window's language. A document's score is the mean of its windows' log probabilities, weighted
by their bytes, over the whole text.

Training takes windows spread evenly over whole texts of labelled rows: at most about
``SAMPLE_DOCS`` documents per language, chosen by a hash of doc_id, and ``SAMPLE_WINDOWS`` windows
of each. Applying the network turns embeddings and filters into tables over byte classes and
pairs of classes, so that a filter is a sum of at most two table rows.

Defined results: a null text, or one without a letter, is ``und`` with score 1; with no labelled
row every text is ``und`` with score 0; repeated rows are predicted each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.llm import words as W
from textdrift.llm.tables import remainder

WIDTH = 128
CLASSES = 96
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_DOCS = 1500
SAMPLE_WINDOWS = 4
STEPS, BATCH, RATE = 700, 64, 0.004
UNKNOWN = "und"
_PAD = max(WIDTHS) - 1


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x (WIDTH + pad) bytes, document of each window, its number of bytes)."""
    sizes = np.diff(offsets)
    per = -(-sizes // WIDTH)
    doc = np.repeat(np.arange(len(sizes)), per)
    first = np.repeat(np.cumsum(per) - per, per)
    at = (np.arange(len(doc)) - first) * WIDTH
    length = np.minimum(sizes[doc] - at, WIDTH)
    source = offsets[:-1][doc] + at
    out = np.zeros((len(doc), WIDTH + _PAD), np.uint8)
    full = np.flatnonzero(length == WIDTH)
    if len(full):
        out[full, :WIDTH] = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[source[full]]
    for w in np.flatnonzero(length < WIDTH).tolist():
        out[w, :length[w]] = data[source[w]:source[w] + length[w]]
    return out, doc, length


@dataclass
class Network:
    """Trained weights; ``classes`` maps bytes to byte classes."""

    languages: list[str]
    classes: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """Per width, the filter responses of one class at each place, joined into pairs."""
        made = []
        for width, f in zip(WIDTHS, self.filters):
            place = [np.ascontiguousarray(self.embedding @ f[j]) for j in range(width)]
            pair = (place[0][:, None, :] + place[1][None, :, :]).reshape(-1, FILTERS).astype(np.float32)
            rest = (None if width == 2 else place[2].astype(np.float32) if width == 3 else
                    (place[2][:, None, :] + place[3][None, :, :]).reshape(-1, FILTERS).astype(np.float32))
            made.append((pair, rest))
        return made

    def log_probabilities(self, rows: np.ndarray, made: list[tuple[np.ndarray, ...]], step: int = 512) -> np.ndarray:
        """Log probabilities of the languages for windows of bytes."""
        result = np.empty((len(rows), len(self.languages)))
        for a in range(0, len(rows), step):
            c = self.classes[rows[a:a + step]]
            pairs = c[:, :-1] * CLASSES + c[:, 1:]
            pooled = []
            for width, (pair, rest), bias in zip(WIDTHS, made, self.biases):
                r = pair[pairs[:, :WIDTH]]
                if width == 3:
                    r += rest[c[:, 2:2 + WIDTH]]
                elif width == 4:
                    r += rest[pairs[:, 2:2 + WIDTH]]
                pooled.append(np.maximum(r.max(axis=1) + bias, 0))
            logits = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            result[a:a + step] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return result


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on the cross entropy of windows; the sample's size is bounded by the caller."""
    rng = np.random.default_rng(seed)
    counts = np.bincount(rows[:, :WIDTH].ravel(), minlength=256)
    counts[0] = 0
    classes = np.zeros(256, np.int32)
    classes[np.argsort(-counts, kind="stable")[:CLASSES - 1]] = np.arange(1, CLASSES)
    n = len(languages)
    weights = [rng.normal(0, 0.3, (CLASSES, EMBEDDING))]
    weights += [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
    weights += [np.zeros(FILTERS) for _ in WIDTHS]
    weights += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n)), np.zeros(n)]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    k = len(WIDTHS)
    by_language = [np.flatnonzero(labels == i) for i in range(n)]
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, max(1, BATCH // n)) for b in by_language])
        c, y = classes[rows[pick]], labels[pick]
        e = weights[0][c]
        pooled, best = [], []
        for i, w in enumerate(WIDTHS):
            r = sum(e[:, j:j + WIDTH] @ weights[1 + i][j] for j in range(w))
            at = r.argmax(axis=1)
            best.append(at)
            pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0] + weights[1 + k + i])
        z = np.concatenate(pooled, axis=1)
        a = np.maximum(z, 0)
        logits = a @ weights[-2] + weights[-1]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        grads = [np.zeros_like(w) for w in weights]
        grads[-2], grads[-1] = a.T @ p, p.sum(axis=0)
        dz = (p @ weights[-2].T) * (z > 0)
        d_e = np.zeros_like(e)
        who = np.arange(len(y))[:, None]
        for i, w in enumerate(WIDTHS):
            d = dz[:, i * FILTERS:(i + 1) * FILTERS]
            grads[1 + k + i] = d.sum(axis=0)
            for j in range(w):
                seen = e[who, best[i] + j]                       # documents x filters x embedding
                grads[1 + i][j] = np.einsum("bfe,bf->ef", seen, d)
                np.add.at(d_e, (who, best[i] + j), d[:, :, None] * weights[1 + i][j].T[None])
        np.add.at(grads[0], c, d_e)
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Network(languages, classes, weights[0], weights[1:1 + k], weights[1 + k:1 + 2 * k], weights[-2], weights[-1])


def training_windows(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample of windows of the labelled rows (doc_id, text, lang)."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items())
                           for x in (lang, int(min(1.0, sample_docs / n) * 1_000_000))]) if counts else None
    if share is None:
        return np.zeros((0, WIDTH + _PAD), np.uint8), np.zeros(0, np.int64), []
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, doc, length = windows(*W.text_bytes(batch.column(1)))
            langs, out, named = batch.column(0).to_pylist(), [], []
            ptr = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for d in range(batch.num_rows):
                n = int(ptr[d + 1] - ptr[d])
                for w in np.unique(np.linspace(0, n - 1, min(n, SAMPLE_WINDOWS)).astype(int)).tolist() if n else []:
                    if length[ptr[d] + w] >= min(WIDTH // 2, length[ptr[d]:ptr[d + 1]].max()):
                        out.append(rows[ptr[d] + w].tobytes())
                        named.append(langs[d])
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.string()), pa.array(out, pa.binary())],
                                             names=["lang", "bytes"])

    rows = chosen.select("lang", "text").mapInArrow(task, "lang string, bytes binary").collect()
    rows = sorted((r.lang, bytes(r.bytes)) for r in rows)
    languages = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    return (np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), WIDTH + _PAD),
            np.array([number[lang] for lang, _ in rows], np.int64), languages)


def predict(documents: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        made = network.tables() if network else None
        for batch in batches:
            column = batch.column(1)
            lettered = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\pL"), False))
            data, offsets = W.text_bytes(column)
            names, scores = [UNKNOWN] * batch.num_rows, np.ones(batch.num_rows)
            if network is None:
                scores[lettered] = 0
            else:
                for a, b in W.slices(data, offsets):
                    rows, doc, length = windows(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    logs = network.log_probabilities(rows, made) * length[:, None]
                    total = np.stack([np.bincount(doc, logs[:, j], b - a) for j in range(logs.shape[1])], axis=1)
                    total /= np.maximum(np.bincount(doc, length, b - a), 1)[:, None]
                    best = total.argmax(axis=1)
                    p = np.exp(total - total.max(axis=1, keepdims=True))
                    p = 1 / p.sum(axis=1)
                    for d in np.flatnonzero(lettered[a:b]).tolist():
                        names[a + d], scores[a + d] = network.languages[best[d]], p[d]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names), pa.array(scores)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                            (remainder(F.col("doc_id"), 4) == 2).alias("held_out")).mapInArrow(
        task, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Train on the rows that are not held out (crc32(doc_id) mod 4 is not 2), predict all rows."""
    rows, labels, languages = training_windows(documents.where(remainder(F.col("doc_id"), 4) != 2).select(
        "doc_id", "text", "lang"), sample_docs)
    return predict(documents, train(rows, labels, languages) if languages else None)

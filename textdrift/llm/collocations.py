"""Operator 11, phrase collocation mining by best-first branch and bound.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
``[^\\x20\\x09]+``; everything is counted per language (null: ``und``). Candidates are the phrases of
two and three words with a = f(phrase) >= ``least``. The score of a cut into a first part and the rest
is floor(1000000 a a / (f(first) f(rest))), that of a phrase the least over its cuts.

Phrases grow word by word. Words are counted, then pairs of words that both occur ``least`` times. A
pair (u, v) with the count p is a prefix; every phrase (u, v, w) has a <= p and f(v, w) >= a, so its
score is at most floor(1000000 p / f(u)). That bound is admissible, and it is the pair's ``grow``.
The frontier of a language holds its pairs by the larger of their own score and their bound, best
first. A round expands all pairs down to a threshold: those whose bound reaches it to the right,
those whose score reaches it also to the left, since whether they survive depends on all longer
phrases that hold them. Then every candidate with a score at the threshold or above is settled. Once
a language has ``top`` surviving ones among them, no phrase below the threshold can enter its
result, ties included; else the next round takes a larger part of the frontier, at last all of it.

The corpus is scanned once for words, once for pairs, once for each round. Counts are made by a
task for each slice of texts and summed by Spark; phrases are compared as texts. What can't be a
candidate is kept from the shuffle by Bloom filters of a bounded size, which lose nothing. Counts are
joined with the heavy keys broadcast (at most 10,000) and the others shuffled, thresholds come from a
histogram of at most 400 cells for each language, and scores are exact decimals.

Defined results: null, empty and blank texts have no words; repeated rows are counted each; a
language without candidates, or an empty table, gives no rows; columns other than ``lang`` and
``text`` are not read; a very long text makes a slice of its own; ties are ranked by a, then phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textdrift.llm import words as W
from textdrift.llm.skew import HEAVY_SHARE, Bloom, attach
from textdrift.llm.tables import written

LEAST, TOP, CONTAINED = 10, 2000, 50
#: The first round expands so many times ``top`` pairs of a language; each next one so many times more.
FRONTIER, WIDEN = 4, 8
SLICE_BYTES = 1 << 20


def _classes() -> tuple[np.ndarray, np.ndarray]:
    breaks = np.zeros(256, dtype=bool)
    breaks[list(b".,;:!?\n\x0b\x0c\r")] = True
    inside = ~breaks
    inside[[0x20, 0x09]] = False
    return inside, breaks


INSIDE, BREAKS = _classes()
NOT_SPACE = np.arange(256) != 0x20


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of a batch of (lang, text)."""
    codes = batch.column(0).dictionary_encode()
    for code, lang in enumerate(codes.dictionary.to_pylist()):
        yield lang, batch.column(1).filter(pc.equal(codes.indices, code))


class Slice:
    """Some texts of one language: their words by number, and where a piece goes on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: str):
        found = W.find_words(data, offsets, INSIDE, lower=True)
        self.lang, self.salt, self.hashes = lang, _salt(lang), W.word_hashes(found)
        _, first, self.word = np.unique(self.hashes, return_index=True, return_inverse=True)
        raw = found.data.tobytes()
        self.vocabulary = pa.array([raw[s:e] for s, e in zip(found.starts[first].tolist(),
                                                             found.ends[first].tolist())], pa.binary())
        doc, breaks = found.doc_of(), np.append(0, np.cumsum(BREAKS[found.data], dtype=np.int32))
        self.goes_on = (doc[1:] == doc[:-1]) & (breaks[found.starts[1:]] == breaks[found.ends[:-1]])

    def phrase_hashes(self, size: int) -> np.ndarray:
        """Of ``size`` words from every place on."""
        return W.mix(W.window_hashes(self.hashes, size) ^ self.salt)

    def places(self, size: int) -> np.ndarray:
        """Mask of the places where ``size`` words of one piece start."""
        n = max(len(self.word) - size + 1, 0)
        out = np.ones(n, dtype=bool)
        for i in range(size - 1):
            out &= self.goes_on[i:i + n]
        return out

    def counts(self, at: np.ndarray, size: int) -> pa.RecordBatch:
        """lang, phrase and n of the phrases that start at the places ``at``."""
        code = self.word[at]
        for i in range(1, size):          # two numbers at a time, so that codes stay in 64 bits
            code = np.unique(code, return_inverse=True)[1] * len(self.vocabulary) + self.word[at + i]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        parts = [self.vocabulary.take(pa.array(self.word[at[first] + i])) for i in range(size)]
        phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
        return pa.RecordBatch.from_arrays(
            [pa.repeat(self.lang, len(n)), phrase.cast(pa.string()), pa.array(n.astype(np.int64))],
            names=["lang", "phrase", "n"])


def _counted(documents: DataFrame, size: int, places: Callable[[Slice], np.ndarray]) -> DataFrame:
    """lang, phrase and n of the phrases of ``size`` words at the ``places`` of each slice; for
    single words also a row with a null phrase: all words of the language."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            for lang, texts in _by_language(batch):
                data, offsets = W.text_bytes(texts)
                for a, b in W.slices(data, offsets, SLICE_BYTES):
                    some = Slice(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lang)
                    if not len(some.word):
                        continue
                    yield some.counts(np.flatnonzero(places(some)), size)
                    if size == 1:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang]), pa.array([None], pa.string()), pa.array([len(some.word)])],
                            names=["lang", "phrase", "n"])

    return documents.mapInArrow(task, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(
        F.sum("n").alias("n"))


def _hashed(phrases: DataFrame, size: int) -> DataFrame:
    """With the ``hash`` by which tasks look a phrase of ``size`` words up."""
    columns = phrases.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.frugal(batches):
            codes = batch.column(0).dictionary_encode()
            salts = np.array([_salt(x) for x in codes.dictionary.to_pylist()], np.uint64)
            data, offsets = W.text_bytes(batch.column(1))
            hashes = W.word_hashes(W.find_words(data, offsets, NOT_SPACE, lower=False))
            windows = W.window_hashes(hashes, size)[::size]
            out = W.mix(windows ^ salts[np.asarray(codes.indices)]) if batch.num_rows else windows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*columns, "hash"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in phrases.dtypes)
    return phrases.mapInArrow(task, f"{kinds}, hash long")


def _exact(text: str) -> str:
    """floor of a quotient of products of counts, as SQL over decimals that hold 38 digits."""
    above, below = text.split("/")
    product = " * ".join(f"cast({x.strip()} AS decimal(18, 0))" for x in above.split("*"))
    divisor = " * ".join(f"cast({x.strip()} AS decimal(18, 0))" for x in below.split("*"))
    return f"cast(({product}) div ({divisor}) AS bigint)"


def _part(first: int, count: int) -> str:
    return f"array_join(slice(split(phrase, ' '), {first}, {count}), ' ')"


def _with_count(rows: DataFrame, table: DataFrame, first: int, count: int, name: str, total: int) -> DataFrame:
    """With ``name``: how often the part of ``count`` words from word ``first`` on occurs."""
    keys = table.select("lang", F.col("phrase").alias("part"), F.col("a").alias(name))
    return attach(rows.withColumn("part", F.expr(_part(first, count))), keys, ["lang", "part"],
                  F.col(name) >= max(1.0, total * HEAVY_SHARE)).drop("part")


def _thresholds(pairs: DataFrame, some: int) -> DataFrame:
    """lang and theta: the ``some`` best of the frontier of a language, or more, reach theta; 0 where
    these are all. Cells are about 4 percent wide."""
    cells = pairs.withColumn("best", F.greatest("score", "grow")).groupBy(
        "lang", F.floor(F.log2(F.col("best") + 1) * 16).alias("cell")).agg(
        F.count("*").alias("n"), F.min("best").alias("best"))
    down = Window.partitionBy("lang").orderBy(F.desc("cell"))
    ranked = cells.withColumn("above", F.sum("n").over(down) - F.col("n"))
    return ranked.groupBy("lang").agg(
        F.when(F.sum("n") <= some, F.lit(0)).otherwise(
            F.min(F.when(F.col("above") < some, F.col("best")))).cast("long").alias("theta"))


def _grown(documents: DataFrame, frontier: DataFrame, frequent: Bloom, least: int) -> DataFrame:
    """lang, phrase and n of the phrases of three words that the expanded pairs of the frontier
    (hash, right, left) lead to."""
    spark = documents.sparkSession
    filters = {}
    for side in ("right", "left"):
        chosen = frontier.where(side).select("hash")
        filters[side] = Bloom.of(chosen, chosen.count())
    shared = spark.sparkContext.broadcast((frequent, filters["right"], filters["left"]))

    def places(some: Slice) -> np.ndarray:
        known, right, left = shared.value
        out, pairs = some.places(3), some.phrase_hashes(2)
        at = np.flatnonzero(out)
        here, there = pairs[at], pairs[at + 1]
        out[at] = (right.has(here) | left.has(there)) & known.has(here) & known.has(there)
        return out

    return _counted(documents, 3, places).where(F.col("n") >= least)


def mine(documents: DataFrame, least: int = LEAST, top: int = TOP, contained: int = CONTAINED,
         frontier: int = FRONTIER, widen: int = WIDEN) -> DataFrame:
    """The ``top`` phrases of every language of ``documents`` (lang, text): lang, rank, phrase, a, l,
    r, n and score. A candidate goes whose words lie within a longer candidate with at least
    ``contained`` percent of its count."""
    spark = documents.sparkSession
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"),
                            F.coalesce("text", F.lit("")).alias("text"))
    table = _counted(docs, 1, lambda some: some.places(1)).where(F.col("n") >= least)
    totals = F.col("phrase").isNull()
    singles = written(table, "counted-words")
    sizes = singles.where(totals).select("lang", "n")
    words = written(_hashed(singles.where(~totals).withColumnRenamed("n", "a"), 1), "words")
    total = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    known = spark.sparkContext.broadcast(Bloom.of(words, words.count()))

    def both(some: Slice) -> np.ndarray:
        often = known.value.has(some.phrase_hashes(1))
        return some.places(2) & often[1:] & often[:-1]

    pairs = written(_counted(docs, 2, both).where(F.col("n") >= least).withColumnRenamed("n", "a"), "pairs")
    pairs = _with_count(_with_count(pairs, words, 1, 1, "l", total), words, 2, 1, "r", total).withColumns({
        "score": F.expr(_exact("1000000 * a * a / l * r")), "grow": F.expr(_exact("1000000 * a / l"))})
    pairs = written(_hashed(pairs, 2), "scored-pairs")
    frequent = Bloom.of(pairs, pairs.count())

    active, some, done = sizes.select("lang"), frontier * top, []
    while True:
        thetas = written(_thresholds(pairs.join(active, "lang", "left_semi"), some).join(
            sizes.withColumnRenamed("n", "words"), "lang"), "thresholds")
        if thetas.isEmpty():
            break
        large = F.col("words") >= total * HEAVY_SHARE
        part = written(attach(pairs, thetas, ["lang"], large).where("greatest(grow, score) >= theta").withColumns({
            "right": F.lit(True), "left": F.col("score") >= F.col("theta")}), "frontier")
        triples = written(_grown(docs, part, frequent, least).withColumnRenamed("n", "a"), "triples")
        triples = _with_count(_with_count(triples, words, 1, 1, "f1", total), pairs, 2, 2, "f23", total)
        triples = _with_count(_with_count(triples, pairs, 1, 2, "f12", total), words, 3, 1, "f3", total)
        triples = written(triples.withColumns({
            "first": F.expr(_exact("1000000 * a * a / f1 * f23")),
            "second": F.expr(_exact("1000000 * a * a / f12 * f3"))}), "scored-triples")
        held = triples.select("lang", F.explode(F.expr(f"array({_part(1, 2)}, {_part(2, 2)})")).alias("phrase"),
                              "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        short = part.where("left").join(held, ["lang", "phrase"], "left").where(
            F.coalesce(100 * F.col("longer") < contained * F.col("a"), F.lit(True)))
        columns = ["lang", "phrase", "a", "l", "r", "score", "theta"]
        long = attach(triples, thetas, ["lang"], large).select(
            "lang", "phrase", "a", F.expr("if(first <= second, f1, f12)").alias("l"),
            F.expr("if(first <= second, f23, f3)").alias("r"), F.least("first", "second").alias("score"), "theta")
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = written(short.select(*columns).unionByName(long.where("score >= theta")).withColumn(
            "rank", F.row_number().over(best)).where(F.col("rank") <= top), "phrases")
        settled = thetas.join(found.groupBy("lang").count(), "lang", "left").where(
            (F.col("theta") == 0) | (F.col("count") >= top)).select("lang")
        settled = written(settled, "settled")
        done.append(found.join(settled, "lang", "left_semi"))
        active = thetas.join(settled, "lang", "left_anti").select("lang")
        some *= widen
    rows = done[0] if done else None
    for more in done[1:]:
        rows = rows.unionByName(more)
    if rows is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, "
                                         "score long")
    return rows.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                           "n", "score")


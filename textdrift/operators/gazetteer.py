"""Mentions by look-up: the longest phrases of a gazetteer that occur in a text.

A phrase and a text are compared as lower-cased tokens ``[a-z0-9]+``. Every span of tokens no
longer than the longest phrase is looked up; a span inside a longer found span of the same text is
dropped, overlapping ones both stay. A phrase of several classes gives a mention of each.

Spans are looked up in the Arrow batch that reads the text while the phrases are few enough to be
broadcast (``BROADCAST_PHRASES``, counted first); no span becomes a row, and only the longest hits of a text,
as one row of numbers, are shuffled then. Beyond that, spans meet the phrases in a shuffle, where each phrase is dealt to ``SALTS`` places, so that a
frequent span is split by its text.

Defined results: NULL and blank texts have no mentions; phrases without a token or class are
passed over; an empty gazetteer gives no mentions; rows of equal ids count as one text.
"""

from __future__ import annotations

import re
import uuid
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textdrift.functions import text as tx
from textdrift.functions import words as wd

BROADCAST_PHRASES = 500_000
SALTS = 16
_TOKEN = re.compile(tx.ROUGE_TOKEN_RE)


def phrase_tokens(text) -> Column:
    return tx.tokens(F.lower(tx.guard_text(text)), tx.ROUGE_TOKEN_RE)


def _phrase_table(phrases: DataFrame) -> DataFrame:
    """_p (tokens joined by a space) and its sorted classes, one row for each phrase."""
    return (phrases.where(F.col("label").isNotNull())
            .select(F.array_join(phrase_tokens("phrase"), " ").alias("_p"), "label").where("_p <> ''")
            .groupBy("_p").agg(F.sort_array(F.collect_set("label")).alias("_labels")))


def _spans(texts: DataFrame, id_cols, text_col: str, longest: int) -> DataFrame:
    """id_cols, _start, _end and _p of every span of at most ``longest`` tokens."""
    found = texts.select(*id_cols, phrase_tokens(text_col).alias("_t"))
    ahead = found.select(*id_cols, F.posexplode(
        F.transform("_t", lambda _, i: F.slice("_t", i + 1, longest))).alias("_start", "_w"))
    span = F.transform(F.sequence(F.lit(1), F.size("_w")), lambda n: F.struct(
        (F.col("_start") + n).alias("_end"), F.array_join(F.slice("_w", 1, n), " ").alias("_p")))
    return ahead.select(*id_cols, "_start", F.inline(span))


class _Trie:
    """The phrases as paths of tokens, in flat arrays that every task reads."""

    def __init__(self, table: DataFrame):
        self.phrases, self.labels, self.tokens = [], [], {}
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for p, labels in table.select("_p", "_labels").toLocalIterator():
            node = 0
            for t in p.split(" "):
                node = edges.setdefault((node, self.tokens.setdefault(t, len(self.tokens))), len(edges) + 1)
            ends[node] = len(self.phrases)
            self.phrases.append(p)
            self.labels.append(list(labels))
        keys = np.array([a << 32 | t for a, t in edges] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([*edges.values()] or [0], np.int64)[order]
        self.phrase_at = np.array([ends.get(n, -1) for n in range(len(edges) + 1)], np.int64)

    def step(self, nodes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The node after each node and token, -1 if there is none."""
        wanted = nodes << 32 | tokens
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((tokens >= 0) & (self.keys[at] == wanted), self.to[at], -1)


class _PhraseWords:
    """Tokens of phrases in the words of texts: no token spans white space, so a word is looked at once, at its first
    use. All words are forgotten when they are too many."""

    def __init__(self, trie: _Trie):
        self.trie = trie
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.lists, self.chars = wd.Numbers(), wd.Lists(), 0

    def hits(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text, start, end, phrase) of the longest phrases of each text, by start."""
        if len(self.numbers) > wd.KNOWN_WORDS or self.chars > wd.KNOWN_CHARS:
            self._forget()
        before = len(self.numbers)
        words, owner = self.numbers.of([t.lower() for t in texts])
        if len(self.numbers) > before:
            new = list(islice(self.numbers, before, None))
            known = self.trie.tokens
            self.chars += sum(map(len, new))
            self.lists.add([[known[w]] if w in known else [known.get(t, -1) for t in _TOKEN.findall(w)] for w in new])
        tokens, of = self.lists.of(words, owner)
        tokens = tokens.astype(np.int64)
        at, found = np.flatnonzero(tokens >= 0), []
        node, n = self.trie.step(np.zeros(len(at), np.int64), tokens[at]), 0
        while True:
            at, node, n = at[node >= 0], node[node >= 0], n + 1
            if not len(at):
                break
            phrase = self.trie.phrase_at[node]
            found.append((at[phrase >= 0], np.full(int((phrase >= 0).sum()), n), phrase[phrase >= 0]))
            on = at + n < len(tokens)
            at, node = at[on], node[on]
            node = np.where(of[at + n] == of[at], self.trie.step(node, tokens[at + n]), -1)
        start, size, phrase = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((-size, start))
        start, end, phrase = start[order], (start + size)[order], phrase[order]
        # texts lie one after the other, so nothing of an earlier text reaches into a later one
        kept = end > np.append(0, np.maximum.accumulate(end)[:-1]) if len(end) else np.zeros(0, bool)
        start, end, phrase = start[kept], end[kept], phrase[kept]
        text = of[start]
        first = np.searchsorted(of, np.arange(len(texts)))[text]
        return text, start - first, end - first, phrase


_phrase_words: dict[str, _PhraseWords] = {}         # by call: a worker keeps those of the last one


def _words_of(call: str, known) -> _PhraseWords:
    if call not in _phrase_words:
        _phrase_words.clear()
        _phrase_words[call] = _PhraseWords(known.value)
    return _phrase_words[call]


def _longest(rows: list[dict]) -> list[tuple[int, int]]:
    """(start, phrase) of the longest hits of the rows of one text, which are longest in their own row."""
    if len(rows) == 1:
        return list(zip(rows[0]["s"], rows[0]["p"]))
    out, reached = [], -1
    for start, end, p in sorted(((s, e, p) for r in rows for s, e, p in zip(r["s"], r["e"], r["p"])),
                                key=lambda h: (h[0], -h[1], h[2])):
        if end > reached:
            reached = end
            out.append((start, p))
    return out


def _mentions_in_task(texts: DataFrame, id_cols, text_col: str, table: DataFrame, each_once: bool) -> DataFrame:
    """``gazetteer_mentions`` of phrases that are broadcast. A text's hits are one row, by the numbers of the phrases."""
    known, call = texts.sparkSession.sparkContext.broadcast(_Trie(table)), uuid.uuid4().hex

    def look_up(text: pa.Array) -> pa.Array:
        words, parts, base = _words_of(call, known), [], 0
        for part in wd.slices([t or "" for t in text.to_pylist()]):
            owner, *found = words.hits(part)
            parts.append((owner + base, *found))
            base += len(part)
        owner, start, end, phrase = (np.concatenate(x) for x in zip(*parts))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=base))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (start, end, phrase)]
        return pa.StructArray.from_arrays(lists, ["s", "e", "p"])
    look_up.__annotations__ = {"text": pa.Array, "return": pa.Array}

    def name(rows: pa.Array) -> pa.Array:
        out, trie = [], known.value
        for r in rows.to_pylist():
            found = _longest(r)
            if each_once:                           # the first start of each phrase
                found = [(start, p) for p, start in dict((p, start) for start, p in reversed(found)).items()]
            out.append([{"mention": trie.phrases[p], "label": label, "start": start}
                        for start, p in found for label in trie.labels[p]])
        return pa.array(out, pa.list_(pa.struct([("mention", pa.string()), ("label", pa.string()), ("start", pa.int32())])))
    name.__annotations__ = {"rows": pa.Array, "return": pa.Array}

    hits = F.arrow_udf(look_up, "struct<s: array<int>, e: array<int>, p: array<int>>")(F.col(text_col))
    per_row = texts.select(*id_cols, hits.alias("_h")).where(F.size("_h.p") > 0)
    per_text = per_row.groupBy(*id_cols).agg(F.collect_list("_h").alias("_h"))
    named = F.arrow_udf(name, "array<struct<mention: string, label: string, start: int>>")(F.col("_h"))
    return per_text.select(*id_cols, named.alias("_m")).select(*id_cols, F.inline("_m"))


def gazetteer_mentions(texts: DataFrame, phrases: DataFrame, id_cols, text_col: str = "text",
                       each_once: bool = False) -> DataFrame:
    """(``id_cols``, mention, label, start): the mentions of ``phrases`` (phrase, label) in each text;
    ``start`` is the place of its first token, from 0. Any ``mentions=`` argument takes this table. With ``each_once``
    a mention of a text that is found several times is one row, with its first start, as sets need it."""
    id_cols = list(id_cols)
    table = _phrase_table(phrases)
    size, longest = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("_p", " "))), F.lit(1))).first()
    if size <= BROADCAST_PHRASES:
        return _mentions_in_task(texts, id_cols, text_col, table, each_once)
    spans = _spans(texts, id_cols, text_col, longest)
    salt = F.pmod(F.xxhash64(*id_cols), F.lit(SALTS)).cast("int")
    dealt = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = spans.withColumn("_salt", salt).join(dealt, ["_p", "_salt"])
    before = Window.partitionBy(*id_cols).orderBy("_start", F.desc("_end")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("_end").over(before)
    kept = hits.withColumn("_reached", reached).where(F.col("_reached").isNull() | (F.col("_reached") < F.col("_end")))
    if each_once:
        kept = kept.groupBy(*id_cols, "_p", "_labels").agg(F.min("_start").alias("_start"))
    return kept.select(*id_cols, F.col("_p").alias("mention"), F.explode("_labels").alias("label"),
                       F.col("_start").alias("start"))

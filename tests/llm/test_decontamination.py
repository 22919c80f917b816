import hashlib
import re

import pytest
from pyspark.sql import types as T

from textdrift.llm import decontamination as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("hit_starts", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType())])


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item or "")
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= owners
        out.append((doc_id, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i % 17}" for i in range(40))
ITEM_ROWS = [("a", "One two three four five six seven eight nine ten eleven twelve"), ("b", "short item"),
             ("c", LONG), (None, "Ünïted wörds"), ("a", "one two three four five six seven eight nine ten"),
             ("e", None), ("f", "  ...  "), ("g", "short item"), ("h", "zebra")]
DOC_ROWS = [(1, "x one, two three FOUR five six-seven eight nine ten eleven y", "p"), (2, None, None), (3, "", "q"),
            (4, "a short item and a Short! Item", None), (5, LONG + " " + LONG, None), (6, "ünïted wörds ÜNÏTED", None),
            (4, "a short item and a Short! Item", None), (None, "zebra zebra", None),
            (8, " ".join(f"f{i}" for i in range(30000)) + " short item", None),
            (9, "one two three four five six seven eight nine", None), (10, "short", None), (11, "item short item", None)]


@pytest.mark.parametrize("shard_words", [D.SHARD_WORDS, 5])
def test_matches_brute_force(spark, shard_words):
    docs, items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    rows = D.contamination(docs, items, shard_words=shard_words).collect()
    assert sorted(map(tuple, rows), key=str) == brute(DOC_ROWS, ITEM_ROWS)


def test_removes_spans_and_covered_documents(spark):
    docs, items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    rows = D.decontaminate(docs, items, max_coverage=0.9).collect()
    kept = {r.doc_id: r.text for r in rows}
    assert kept[1] == "x  y" and kept[2] is None and kept[3] == "" and 5 not in kept and None not in kept
    assert kept[9] == DOC_ROWS[9][1] and kept[8].endswith("f29999 ")
    assert rows[0].asDict().keys() == {"doc_id", "text", "hit_starts"} and rows[0].hit_starts == "p"


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    docs, items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert D.contamination(none, items).count() == 0
    assert not any(r.contaminated for r in D.contamination(docs, no_items).collect())


def test_automaton_tracks_longest_matches():
    a = D.SuffixAutomaton()
    for s in ([1, 2, 3, 1, 2, 4], [2, 3, 3, 1], [1, 2, 3, 1, 2, 4], [5]):
        a.add(s)
    parts = {tuple(s[i:j]) for s in ([1, 2, 3, 1, 2, 4], [2, 3, 3, 1], [5]) for i in range(7) for j in range(i + 1, 8)}
    text = [1, 2, 3, 3, 1, 2, 3, 1, 2, 4, 5, 9, 2, 3, 1, 2]
    state = length = 0
    for i, word in enumerate(text):
        state, length = a.step(state, length, word)
        assert length == max((n for n in range(i + 2) if n and tuple(text[i + 1 - n:i + 1]) in parts), default=0)

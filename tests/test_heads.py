"""Heads of groups told by their keys; TF-IDF by word numbers; what L2, L3 and L8 store."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textdrift.functions import words as wd
from textdrift.operators import learn as le
from textdrift.operators import reshape as rs
from textdrift.plans import catalog_more as more


def test_head_condition_keeps_the_balanced_rows(spark):
    rows = [("a" if i % 5 else "b" if i % 2 else None, None if i % 7 == 0 else i, f"k{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "label string, i long, k string").withColumn("text", F.lit("long"))
    ids = ["i", "k"]
    head = rs.head_condition(df, "label", ids, lambda total, mn: mn)
    kept = df.where(head)
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
    want = rs.balance_classes(df, "label", ids)
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect())) and kept.count() == 90
    test = rs.head_condition(want, "label", ids, lambda total, mn: F.ceil(total * F.lit(0.25)))
    split = {r.k: r.split for r in rs.stratified_split(want, "label", ids, 0.25).collect()}
    assert {r.k: r.split for r in want.withColumn("split", F.when(test, "test").otherwise("train")).collect()} == split


def test_chains_with_some_texts_are_the_same_chains(spark):
    v = spark.createDataFrame([("d", "k", "s", "o", "original", 0), ("d", "k", "s", "b", "palm", 1), (None, "k", "s", "c", "palm_palm", 2),
                               ("d", "k", "s", None, "palm", 0), (None, "k", "s", "e", "dipper", 1)],
                              "dataset string, key string, source string, text string, version_name string, seq long")
    keys = lambda ch: sorted(map(str, ch.select(*rs.CHAIN_KEYS, "family", "T0").collect()))
    some = rs.chains_with(v, ["T0"])
    assert keys(some) == keys(rs.build_chains(v)) and some.where("T1 is not null or T2 is not null").isEmpty()


@pytest.mark.parametrize("slice_chars,known_words", [(2_000_000, 300_000), (30, 3)])
def test_term_weights_by_their_definition(spark, monkeypatch, slice_chars, known_words):
    monkeypatch.setattr(wd, "SLICE_CHARS", slice_chars)
    monkeypatch.setattr(wd, "KNOWN_WORDS", known_words)
    rng = random.Random(1)
    parts = ["Red", "red,", "fox", ".", "a", "the-fox", "élan", "\n", "x1"]
    docs = [[" ".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(rng.choice([1, 1, 2]))] for _ in range(60)]
    docs += [docs[-1], [], [""], ["Red", "fox"]]
    known = {t: (i, 1.0 + i / 7) for i, t in enumerate(["élan", "fox", "fox red", "red", "red fox", "the", "the fox", "x1 x1"])}
    terms, got = wd.TermWeights(known), []
    for part in wd.slices(docs, lambda d: sum(map(len, d))):
        of, index, w = terms.of(part)
        got += [{int(i): x for d, i, x in zip(of, index, w) if d == k} for k in range(len(part))]
    for d, have in zip(docs, got, strict=True):
        raw = {known[t][0]: (1 + math.log(n)) * known[t][1] for t, n in wd.term_counts(d).items() if t in known}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        assert have.keys() == raw.keys() and all(math.isclose(have[i], raw[i] / norm) for i in raw), d


def test_equal_texts_of_consecutive_rows_are_counted_once_and_weigh_as_often(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red fox red"), (3, "fox"), (4, "red fox red"), (5, None)], "id long, text string")
    got = {r.term: (r.df, r.cf) for r in le.fit_vocabulary(docs.coalesce(1), "id", "text", None, 1, one_row_each=True).collect()}
    assert got == {"red": (3, 6), "fox": (4, 4), "red fox": (3, 3), "fox red": (3, 3)}
    alone, place = wd.runs(["a", "a", None, None, "b", "a"])
    assert alone == ["a", None, "b", "a"] and place.tolist() == [0, 0, 1, 1, 2, 3] and not len(wd.runs([])[1])


def test_weights_are_counted_without_term_rows(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red"), (None, "fox"), (2, None), (3, "fox fox")], "id long, text string")
    vocab = le.fit_vocabulary(docs, "id", "text", None, 1)
    w = le.tfidf_weights(docs, vocab, "id")
    assert w._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 3     # texts, and those of the vocabulary
    got = Counter(r.id for r in w.collect())
    assert got == {1: 3, 3: 2}
    norms = {r.id: r.n for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert all(math.isclose(n, 1.0) for n in norms.values())


@pytest.mark.parametrize("query,texts", [(more.l2_train_attribution, {"T0"}), (more.l8_fingerprint_features, set())])
def test_only_fitted_texts_are_stored(spark, sf_small, monkeypatch, query, texts):
    columns, keep = set(), le.stored
    seen = lambda df, name, *a: columns.update(df.columns) or keep(df, name, *a)
    monkeypatch.setattr(le, "stored", seen)
    monkeypatch.setattr(more, "stored", seen)
    rows = query(spark, sf_small).collect()
    assert rows and columns & {"T0", "T1", "T2", "T3", "text", "_texts"} == texts
    assert np.all([r[0] is not None for r in rows])

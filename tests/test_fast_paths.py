"""Counts taken in Arrow batches against plain definitions."""
import random
import re
from collections import Counter

import pytest

from textdrift.functions import overlap
from textdrift.functions import words as wd
from textdrift.operators import entities as en
from textdrift.operators import learn as le
from textdrift.operators import reshape as rs

PIECES = ["Anna", "Van Berg", "x1", "3.14", "1,000.5", "7.", "a@b.org", "me.you@Site.co.uk", "@", "http://Q.x/Y", "https://",
          "ftp://z", "NASA", "iPhone", "É", "Émile Zola", "ΟΔΟΣ", "٣٤", " ", "\n", "word", "Mc Donald", "A", "Zz9Yy"]


def test_mentions_equal_the_patterns(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", " ", ", "]).join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(300)]
    texts += [t.encode("ascii", "ignore").decode().replace("@", "").replace("://", "") for t in texts] + ["", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F
    found = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(en.MENTION_RE), 0)
    plain = F.array_distinct(F.transform(found, lambda m: F.lower(F.trim(m))))
    typed = F.array_distinct(F.transform(found, lambda m: F.struct(F.lower(F.trim(m)).alias("text"),
                                                                   en.mention_label(m).alias("label"))))
    for r in df.select("t", en.entity_set("t").alias("a"), plain.alias("b"),
                       en.entity_set_typed("t").alias("c"), typed.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.t


def test_mentions_and_features_evaluate_no_lambda_for_each_word(spark):
    df = spark.createDataFrame([("New York",)], "t string")
    plan = df.select(en.entity_set("t"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_clipped_matches_with_a_known_word_table():
    rng = random.Random(5)
    known = overlap.Words()
    for _ in range(20):
        texts = [" ".join(rng.choices(["ab", "Ab-c", "d.d", "é", "1x", "ΣΑΣ", "--"], k=rng.randint(0, 15))) for _ in range(12)]
        reference = [-1, -1, -1] + [rng.choice([-1, 0, 1, 2]) for _ in texts[3:]]
        for grams, pattern in zip(known.tokenise(texts), (r"[^\W_]+|[^\w\s]|_", "[a-z0-9]+")):
            tokens = [re.findall(pattern, t.lower()) for t in texts]
            assert grams.counts.tolist() == [len(t) for t in tokens]
            for n in (1, 2):
                bags = [Counter(zip(*[t[i:] for i in range(n)])) for t in tokens]
                import numpy as np
                got = overlap.clipped_matches(*grams.of(n), np.array(reference), len(texts))
                assert got.tolist() == [0 if r < 0 else (bags[i] & bags[r]).total() for i, r in enumerate(reference)]


def test_words_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(overlap, "KNOWN_WORDS", 2)
    known = overlap.Words()
    first = known.tokenise(["a b c", "c-d"])
    again = known.tokenise(["c-d", "a b c"])
    assert len(known.numbers) == 4
    assert first[0].counts.tolist() == again[0].counts.tolist()[::-1] == [3, 3]


def test_only_the_counts_of_the_metrics_are_taken():
    assert not {c for c in overlap.count_columns(["rouge1"]) if c.startswith(("m_bleu", "m_rouge2", "lcs"))}


def test_tfidf_counts_no_term_rows_and_merges_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Red red fox"), (1, "fox"), (2, "red FOX"), (3, None), (None, "fox")], "id long, text string")
    vocab = le.fit_vocabulary(docs, "id", "text", None, 1)
    got = {r.term: (r.df, r.cf) for r in vocab.collect()}
    assert got == {"red": (2, 3), "fox": (3, 4), "red red": (1, 1), "red fox": (2, 2)}
    plan = vocab._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan
    fast = sorted((r.id, r.text or "", str(r.features.indices), [round(v, 12) for v in r.features.values])
                  for r in le.transform_tfidf(docs, vocab, "id", "text").collect())
    monkeypatch.setattr(le, "TASK_TERMS", 1)
    slow = sorted((r.id, r.text or "", str(r.features.indices), [round(v, 12) for v in r.features.values])
                  for r in le.transform_tfidf(docs, vocab, "id", "text").collect())
    assert fast == slow and len(fast) == 4


def test_confusion_counts_the_predictions_once(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("c", "a")]
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    pred = spark.createDataFrame(rows, "label string, prediction string").mapInArrow(look, "label string, prediction string")
    m = {r.cls: r for r in le.multiclass_metrics(pred).collect()}
    assert (m["a"].support, m["a"].precision, m["b"].support, m["a"].accuracy) == (4, 0.75, 0, pytest.approx(0.6))
    assert seen.value == 5
    cells = {(r.label, r.prediction): r.n for r in le.confusion_matrix(pred).collect()}
    assert cells == {("a", "a"): 3, ("a", "b"): 1, ("a", "c"): 0, ("c", "a"): 1, ("c", "b"): 0, ("c", "c"): 0}
    assert seen.value == 10


def test_chain_stages_are_those_of_the_chains(spark):
    v = spark.createDataFrame([("d", "k", "s", "o", "original", 0), ("d", "k", "s", "b", "palm", 1), ("d", "k", "s", None, "palm", 1),
                               ("d", "k", "s", "c", "palm_palm", 2), ("d", "k", "s", "c", "dipper", 1)],
                              "dataset string, key string, source string, text string, version_name string, seq long")
    def marks(chains):
        return sorted((r.paraphraser, *[r[s] is not None for s in ("T0", "T1", "T2", "T3")]) for r in chains.collect())
    assert marks(rs.chain_stages(v)) == marks(rs.build_chains(v)) == [
        ("dipper", True, True, False, False), ("palm", True, False, True, False)]


def test_mention_label_of_a_capital_scheme():
    assert [wd.mention_label(m) for m in ("http://x", "HTTP://x", "a@b.c", "٣", "Ann")] == ["URL", "NAME", "EMAIL", "NUMBER", "NAME"]

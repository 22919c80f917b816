"""What a query computes once: each text's words, the features it reports, the values it ranks."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textdrift.functions import words as wd
from textdrift.operators import style as sy
from textdrift.plans import catalog_more as more
from textdrift.sources import fixtures as fx

RULES = ({"the": "DET", "of": "ADP"}, [("ADV", "ly$"), ("VERB", "(ing|ed)$")])
TAGS = ["DET", "ADP", "ADV", "VERB", "NUM", "PUNCT", "SYM"]


def _plain(t):
    """The counts of a text by the regular expressions that define them."""
    t = t or ""
    sizes = [k for p in wd._SENTENCE_END.split(t) if (k := len(wd._SPOKEN_WORD.findall(p)))]
    found = wd._TOKEN.findall(t)
    tagged = [wd._rule_tag(x, RULES[0], [(n, wd.re.compile(p)) for n, p in RULES[1]]) for x in found]
    far = [int(np.log2(i)) for i in range(1, len(found) + 1)]
    return ((len(sizes), sum(sizes), sum(k * k for k in sizes)), wd._distinct_share(t),
            sum(map(t.count, wd.string.punctuation)) / len(t) if t.strip() else 0.0,
            len(found), [tagged.count(x) for x in TAGS], sum(far), max(far, default=0))


@pytest.mark.parametrize("slice_chars,known", [(2_000_000, 300_000), (40, 5)])
def test_style_counts_equal_their_definitions(spark, monkeypatch, slice_chars, known):
    monkeypatch.setattr(wd, "SLICE_CHARS", slice_chars)
    monkeypatch.setattr(wd, "KNOWN_WORDS", known)
    words = wd._StyleWords(*RULES)
    rng = random.Random(3)
    parts = ["The", "the", "of", "quickly.", "walked!", "...", "3,5", "½", "İstanbul", "ΣΑΣ.", "o'clock", "_x", "中文", "a\x85b", "?",
             "\n", " ", "  ", "x@y.z", "ÀÉ", "\U0001F600", "٣"]
    texts = [" ".join(rng.choices(parts, k=k)) for k in range(30) for _ in range(3)] + ["", " \t", None]
    for part in wd.slices([t or "" for t in texts]):
        w, owner = words.of(part)
        sl = wd._sentence_counts(words, w, owner, len(part))
        share = wd._distinct_share_counts(words, w, owner, len(part))
        for i, t in enumerate(part):
            assert tuple(int(x[i]) for x in sl) == _plain(t)[0] and share[i] == _plain(t)[1], t
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", wd.style_counts(F.col("text"), TAGS, *RULES).alias("s")).collect():
        s = r.s
        assert (tuple(s.sl), s.ttr, s.punct_ratio, s.n, s.c, s.far, s.deepest) == _plain(r.text), r.text


def test_rule_depths_are_those_of_the_trees():
    sizes = np.array([3, 0, 1, 17, 16])
    for a, b in zip(wd.rule_depths(sizes), wd.tree_depths(wd.rule_heads(sizes), sizes)):
        assert a.tolist() == b.tolist()


def test_features_that_are_not_reported_are_not_counted(spark, sf_small):
    cosine = more._fchains(spark, sf_small)
    assert [f.name for f in cosine.schema["f_T0"].dataType] == more.POS16
    depth = more._fchains(spark, sf_small, (), ["dep_depth_mean"])
    assert [f.name for f in depth.schema["f_T0"].dataType] == ["dep_depth_mean"]


def test_distribution_computes_its_values_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        calls.add(1)
        return float(x)
    long = spark.range(100).select(F.lit("T0").alias("stage"), seen("id").alias("x"))
    (r,) = sy.distribution_by_stage(long, "x").collect()
    assert (r.q1, r["median"], r.q3, r.n) == (24.75, 49.5, 74.25, 100) and calls.value == 100


def test_both_ways_of_the_version_fixture_give_the_same_rows(spark, sf_small, capsys):
    a, b = fx.versions(spark, sf_small), fx.versions(spark, sf_small, in_batches=True)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    a.groupBy("dataset", "key", "source").count().explain()
    assert "ENSURE_REQUIREMENTS" not in capsys.readouterr().out      # R1 shuffles no text
    more._features(spark, sf_small, scalars=()).explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


def test_js_distance_sums_each_vector_once(spark):
    from textdrift.functions import vectors as vx
    df = spark.createDataFrame([([0.0, 1.0, 0.25], [0.5, 0.0, 0.5])], "a array<double>, b array<double>")
    (r,) = df.select(vx.js_distance("a", "b").alias("d"), vx.js_distance("a", "a").alias("same")).collect()
    p, q = (np.array(x) + 1e-10 for x in ([0.0, 1.0, 0.25], [0.5, 0.0, 0.5]))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    assert abs(r.d - np.sqrt((p * np.log(p / m) + q * np.log(q / m)).sum() / 2)) < 1e-12 and r.same == 0.0


@pytest.mark.parametrize("slice_chars", [2_000_000, 30])
def test_gazetteer_in_batches_equals_its_spans(spark, monkeypatch, slice_chars):
    from textdrift.operators import gazetteer as gz
    monkeypatch.setattr(wd, "SLICE_CHARS", slice_chars)
    rng = random.Random(5)
    words = ["a", "b", "c", "A.b", "c,", "d", "é", "aé", "\n", "B"]
    rows = [(i % 40, " ".join(rng.choices(words, k=rng.randrange(25)))) for i in range(40)]
    rows += [(None, "a b c"), (None, None), (50, None), (51, ""), (52, "a b c d"), (52, "x a b c d a")]
    texts = spark.createDataFrame(rows, "id int, text string")
    phrases = spark.createDataFrame([("a", "X"), ("a b", "X"), ("A B", "Y"), ("b c d", "X"), ("c", "Z"), ("d a", "Y"), (" ", "X"),
                                     ("q", None)], "phrase string, label string")
    got = sorted(map(tuple, gz.gazetteer_mentions(texts, phrases, ["id"]).collect()), key=str)
    once = gz.gazetteer_mentions(texts, phrases, ["id"], each_once=True).collect()
    assert "Window" not in gz.gazetteer_mentions(texts, phrases, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(gz, "BROADCAST_PHRASES", 0)
    assert got == sorted(map(tuple, gz.gazetteer_mentions(texts, phrases, ["id"]).collect()), key=str)
    first = {}
    for i, mention, label, start in got:
        first[i, mention, label] = min(start, first.get((i, mention, label), start))
    assert {(i, m, x): start for i, m, x, start in once} == first and len(once) == len(first)
    other = gz.gazetteer_mentions(texts, phrases, ["id"], each_once=True).collect()
    assert sorted(map(tuple, other), key=str) == sorted(map(tuple, once), key=str)


def test_the_audit_reads_the_chains_once_for_content_and_wording(spark, sf_small):
    from textdrift.plans import catalog
    content, wording = more._content_and_wording(spark, sf_small)
    assert sorted(map(tuple, content.collect())) == sorted(map(tuple, more.e6_retention_summary(spark, sf_small).collect()))
    m1 = catalog.QUERIES["m1_bleu2"](spark, sf_small)
    assert wording.columns == m1.columns
    assert wording.exceptAll(m1).isEmpty() and m1.exceptAll(wording).isEmpty()
    plan = content.unionByName(wording, allowMissingColumns=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "T0#" not in plan

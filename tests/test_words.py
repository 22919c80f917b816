import numpy as np
import pytest
from pyspark.sql import functions as F

from textdrift.functions import text as tx
from textdrift.functions import words as wd
from textdrift.operators import style as sy

TEXTS = ["The cat ran quickly. It was 12 o'clock!  Really?\nYes... 3,5 ½ Straße €_x", "", "  \n", None, "...", "a",
         "naming the İstanbul ΣΣ movement famous. 中文 ٣ (see: e.g. x)"]


def _versions(spark):
    rows = [("d", f"k{i}", "s", "original", 0, t) for i, t in enumerate([*TEXTS, TEXTS[0]])]
    rows.append(("d", "k0", "s", "original", 0, "another text of the same id."))
    rows.append((None, None, "s", "original", 0, TEXTS[0]))
    return spark.createDataFrame(rows, "dataset string, key string, source string, version_name string, seq long, text string")


@pytest.mark.parametrize("with_depth", [True, False])
def test_rule_tagger_without_token_rows_equals_its_annotation_table(spark, capsys, with_depth):
    v = _versions(spark)
    own = sy.style_features(v, with_depth=with_depth)
    table = sy.style_features(v, with_depth=with_depth, annotations=sy.annotate(v))
    key = lambda r: str((r[:5], r.sent_len_mean, r.punct_ratio))
    assert sorted(map(tuple, own.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)
    own.explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "Join" not in plan and "ArrowEvalPython" in plan


def test_counts_equal_the_regular_expressions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    guard = tx.guard_text("text")
    stripped = F.regexp_replace(F.lower("text"), r"[^a-z0-9 ]", "")
    alpha = tx.tokens(F.lower(guard), tx.ALPHA_RE)
    got = df.select("text", tx.word_count("text"), F.size(tx.tokens("text", tx.WORD_RE)).cast("long"),
                    tx.clean_text("text"), F.trim(F.regexp_replace(stripped, " +", " ")),
                    sy.type_token_ratio("text"), F.when(F.size(alpha) > 0, F.size(F.array_distinct(alpha)) / F.size(alpha)).otherwise(0.0),
                    sy.punct_ratio("text"), F.when(F.length(guard) > 0, (F.length(guard) - F.length(
                        F.regexp_replace(guard, tx.PUNCT_CLASS_RE, ""))) / F.length(guard)).otherwise(0.0)).collect()
    for r in got:
        assert r[1] == r[2] and r[3] == r[4] and r[5] == r[6] and r[7] == r[8], r


def test_sentence_statistics(spark):
    df = spark.createDataFrame([(t,) for t in ("One two. Three - four five! ... 6", "a.b c.", None, " ")], "text string")
    got = [tuple(r.s) for r in df.select(sy.sentence_length("text").alias("s")).collect()]
    assert got == [(3, 6, 14), (1, 2, 4), (0, 0, 0), (0, 0, 0)]


def test_stopwords_and_distinct_words(spark):
    df = spark.createDataFrame([("the cat the mat",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(tx.remove_stopwords("t"), tx.remove_stopwords("t", []), tx.unique_word_count("t")).collect()]
    assert got == [("cat mat", "the cat the mat", 3), ("", "", 0), (None, None, None)]


def test_tree_depths_of_any_heads_and_a_cycle():
    total, deepest = wd.tree_depths(np.array([1, 1, 2, 3, 4, 1]), np.array([5, 0, 1]))
    assert total.tolist() == [10, 0, 0] and deepest.tolist() == [4, 0, 0]
    with pytest.raises(ValueError):
        wd.tree_depths(np.array([1, 3, 2]), np.array([3]))


def test_gazetteer_spans_are_looked_up_without_span_rows(spark, capsys):
    from textdrift.operators.gazetteer import gazetteer_mentions
    texts = spark.createDataFrame([(1, "The old New York Times, in York"), (1, "the Old"), (2, None)], "id int, text string")
    phrases = spark.createDataFrame([("new york", "PLACE"), ("York", "PLACE"), ("the old", "ORG"), ("new york times", "ORG")],
                                    "phrase string, label string")
    found = gazetteer_mentions(texts, phrases, ["id"])
    assert sorted(map(tuple, found.collect())) == [
        (1, "new york times", "ORG", 2), (1, "the old", "ORG", 0), (1, "york", "PLACE", 6)]
    found.explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" in plan and "posexplode" not in plan

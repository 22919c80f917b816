from pyspark.sql import functions as F

from textdrift.functions import text as tx


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr("v") if callable(expr) else expr).first()[0]


def test_stage_mapping(spark):
    cases = {"original": "T0", "a": "T1", "a_a": "T2", "a_a_a": "T3", "a_a_a_a": "T3"}
    for v, want in cases.items():
        assert one(spark, tx.stage_of, v) == want


def test_mixed_chain_paraphraser_is_first_segment(spark):
    assert one(spark, tx.paraphraser_of, "chatgpt_dipper") == "chatgpt"
    assert one(spark, tx.stage_of, "chatgpt_dipper") == "T2"
    assert one(spark, tx.paraphraser_of, "original") == "original"


def test_family(spark):
    for p, want in {"dipper": "dipper", "original": "none", "foo": "unknown",
                    "pegasus(slight)": "pegasus", "chatgpt": "chatgpt"}.items():
        assert one(spark, lambda c: tx.family_of(c), p) == want


def test_clean_text_fuses_newlines_and_drops_non_ascii(spark):
    assert one(spark, tx.clean_text, "a\nb  C-d é") == "ab cd"
    assert one(spark, tx.clean_text, "  Hello,   World!! ") == "hello world"
    assert one(spark, tx.clean_text, "") == ""


def test_remove_stopwords_keeps_repeats_and_apostrophe_words_never_match(spark):
    df = spark.createDataFrame([("i dont i like it it",)], "v string")
    got = df.select(tx.remove_stopwords("v", ["i", "don't", "it"])).first()[0]
    assert got == "dont like"


def test_word_count_python_whitespace(spark):
    assert one(spark, tx.word_count, "a b\tc\nd e  ") == 5
    assert one(spark, tx.word_count, "") == 0


def test_guard_text(spark):
    assert one(spark, tx.guard_text, None) == ""
    assert one(spark, tx.guard_text, "   ") == ""
    assert one(spark, lambda c: tx.guard_text(c, 3), "abcdef") == "abc"


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(tx.bigrams(F.col("t"))).collect()]
    assert got == [["a b", "b c"], [], []]

"""The version fixture's word drops against the plain definition (FIXTURES.md, F1)."""
import random

from textdrift.sources import fixtures as fx


def test_kept_words_by_definition(spark):
    rng = random.Random(7)
    words = ["a", "bb", "", "", "c\nd", "é", "\U0001F600x", "$1", "\\", "\t", "\r", "tail"]
    texts = [" ".join(rng.choices(words, k=k)) for k in range(40) for _ in range(4)] + ["", " ", "  ", "one", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rates = sorted({(m, n) for _, m in fx.F1_REWRITERS for n in (1, 2, 3)})
    for r in df.select("text", *[fx.kept_words("text", m, n).alias(f"{m}_{n}") for m, n in rates]).collect():
        for m, n in rates:
            plain = None if r.text is None else " ".join(
                [w for i, w in enumerate(r.text.split(" ")) if (i + 1) % m >= n])
            assert r[f"{m}_{n}"] == plain, (r.text, m, n)


def test_versions_evaluate_no_lambda(spark, sf_small):
    v = fx.versions(spark, sf_small)
    assert "lambda" not in v._jdf.queryExecution().optimizedPlan().toString()
    names = v.select("version_name")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in names

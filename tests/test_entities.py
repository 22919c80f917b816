import pytest

from textdrift.operators import entities as en


def ret(spark, ref, hyp):
    df = spark.createDataFrame([(ref, hyp)], "a array<string>, b array<string>")
    return df.select(en.retention(df.a, df.b).alias("r")).first().r


def test_retention_edge_cases(spark):
    r = ret(spark, [], [])
    assert (r.jaccard, r.recall, r.precision, r.n_shared) == (1.0, 1.0, 1.0, 0)
    r = ret(spark, [], ["x"])
    assert (r.jaccard, r.recall, r.precision) == (0.0, None, 0.0)
    r = ret(spark, ["x"], [])
    assert (r.jaccard, r.recall, r.precision) == (0.0, 0.0, None)


def test_retention_values(spark):
    r = ret(spark, ["a", "b"], ["b", "c"])
    assert r.jaccard == pytest.approx(1 / 3)
    assert (r.recall, r.precision, r.n_ref, r.n_hyp, r.n_shared) == (0.5, 0.5, 2, 2, 1)
    assert r.jaccard <= min(r.recall, r.precision)


def test_entity_set_patterns(spark):
    df = spark.createDataFrame([("Visit New York in 2021, mail a.b@c.org or http://x.y/z. ok",)],
                               "t string")
    got = sorted(df.select(en.entity_set("t")).first()[0])
    assert got == ["2021", "a.b@c.org", "http://x.y/z.", "visit new york"]
    typed = df.select(en.entity_set_typed("t")).first()[0]
    labels = {r.text: r.label for r in typed}
    assert labels["2021"] == "NUMBER" and labels["a.b@c.org"] == "EMAIL"
    assert labels["visit new york"] == "NAME"


def test_blank_text_has_empty_set(spark):
    df = spark.createDataFrame([(None,), ("   ",)], "t string")
    assert [r[0] for r in df.select(en.entity_set("t")).collect()] == [[], []]

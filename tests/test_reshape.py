from pyspark.sql import Window
from pyspark.sql import functions as F

from textdrift.operators import reshape as rs


def labelled(spark, n=3000):
    rows = [(i, "A" if i % 10 < 7 else ("B" if i % 10 < 9 else "C")) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label string")


def test_flag_head_per_group_equals_window_cut(spark):
    df = labelled(spark).withColumn("_rk", rs.rank_key(5, ["id"]))
    k_of = lambda total, mn: F.least(total, F.lit(123))
    got = rs.flag_head_per_group(df, ["label"], "_rk", ["id"], k_of).where("_head")
    w = Window.partitionBy("label").orderBy("_rk", "id")
    want = df.withColumn("rn", F.row_number().over(w)).where("rn <= 123")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_balance_classes_equal_sizes_and_repeatable(spark):
    df = labelled(spark)
    b1 = rs.balance_classes(df, "label", ["id"], seed=42)
    counts = {r.label: r["count"] for r in b1.groupBy("label").count().collect()}
    assert set(counts.values()) == {300}
    b2 = rs.balance_classes(df.repartition(5), "label", ["id"], seed=42)
    assert sorted(r.id for r in b1.collect()) == sorted(r.id for r in b2.collect())


def test_stratified_split_disjoint_and_complete(spark):
    df = labelled(spark)
    sp = rs.stratified_split(df, "label", ["id"], 0.25, seed=1)
    assert sp.count() == 3000
    c = {(r.label, r.split): r["count"] for r in sp.groupBy("label", "split").count().collect()}
    assert c[("A", "test")] == 525 and c[("B", "test")] == 150 and c[("C", "test")] == 75


def test_sample_n_per_group(spark):
    df = labelled(spark)
    s = rs.sample_n(df, 50, ["id"], by=["label"], seed=3)
    assert {r.label: r["count"] for r in s.groupBy("label").count().collect()} == \
        {"A": 50, "B": 50, "C": 50}
    overall = rs.sample_n(df, 10, ["id"], seed=3)
    assert overall.count() == 10


def test_dedup_first_deterministic(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("j", 5, "q")],
                               "k string, o int, v string")
    got = sorted(tuple(r) for r in rs.dedup_first(df, ["k"], ["o"]).collect())
    assert got == [("j", 5, "q"), ("k", 1, "z")]


def test_lookup_chain_not_found(spark):
    ch = spark.createDataFrame([("d", "k", "s", "p", "f", "a b", None, None, None)],
                               "dataset string, key string, source string, paraphraser string, "
                               "family string, T0 string, T1 string, T2 string, T3 string")
    got = {r.stage: r for r in rs.lookup_chain(ch, "d", "k", "s", "p").collect()}
    assert got["T0"].word_count == 2 and got["T0"].found
    assert not got["T1"].found and got["T1"].word_count == 0
    miss = rs.lookup_chain(ch, "d", "nope", "s", "p").collect()
    assert all(not r.found for r in miss) and len(miss) == 4


def test_null_labels_are_a_class_of_their_own(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "A") for i in range(40)], "id long, label string")
    split = rs.stratified_split(df, "label", ["id"], 0.25)
    assert split.count() == 40 and split.where("split = 'test'").groupBy("label").count().count() == 2
    assert rs.balance_classes(df.where("id < 30 OR label IS NULL"), "label", ["id"]).groupBy("label").count() \
        .select("count").distinct().count() == 1


def test_seeded_order_is_repeatable(spark):
    df = labelled(spark, 200)
    first = [r.id for r in rs.seeded_order(df, ["id"], 3).collect()]
    assert first == [r.id for r in rs.seeded_order(df.repartition(4), ["id"], 3).collect()]
    assert sorted(first) == list(range(200)) and first != list(range(200))

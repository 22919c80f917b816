from pyspark.sql import functions as F

from textdrift.operators import reshape as rs

SCHEMA = "dataset string, source string, key string, text string, version_name string, seq long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_only_t0_gives_no_chain_and_missing_stage_stays_null(spark):
    v = rows(spark, [("d", "Human", "k1", "orig1", "original", 0),
                     ("d", "Human", "k2", "orig2", "original", 0),
                     ("d", "Human", "k2", "two", "palm_palm", 2)])
    ch = rs.build_chains(v).collect()
    assert len(ch) == 1
    r = ch[0]
    assert (r.key, r.paraphraser, r.family, r.T0, r.T1, r.T2, r.T3) == \
        ("k2", "palm", "palm", "orig2", None, "two", None)


def test_first_row_wins_for_any_partitioning(spark):
    data = [("d", "AI", "k", "t0", "original", 0),
            ("d", "AI", "k", "late", "chatgpt", 7),
            ("d", "AI", "k", "early", "chatgpt", 3),
            ("d", "AI", "k", "x3", "chatgpt_chatgpt_chatgpt_chatgpt", 9)]
    base = rows(spark, data)
    for parts in (1, 3, 8):
        ch = rs.build_chains(base.repartition(parts)).collect()
        assert [(r.T1, r.T3) for r in ch] == [("early", "x3")]


def test_original_prefixed_versions_are_not_chains(spark):
    v = rows(spark, [("d", "AI", "k", "t0", "original", 0),
                     ("d", "AI", "k", "odd", "original_x", 1),
                     ("d", "AI", "k", "p", "palm", 1)])
    ch = rs.build_chains(v).collect()
    assert [r.paraphraser for r in ch] == ["palm"]


def test_null_keys_group_together(spark):
    v = rows(spark, [("d", None, "k", "t0", "original", 0), ("d", None, "k", "p", "palm", 1)])
    ch = rs.build_chains(v).collect()
    assert len(ch) == 1 and ch[0].T0 == "t0" and ch[0].T1 == "p"


def test_no_rewrites_gives_empty(spark):
    v = rows(spark, [("d", "AI", "k", "t0", "original", 0)])
    assert rs.build_chains(v).count() == 0


def test_unknown_rewriters_and_null_version_names(spark):
    v = rows(spark, [("d", "AI", "k", "t0", "original", 0), ("d", "AI", "k", "new", "brand-new", 1),
                     ("d", "AI", "k", "lost", None, 2), ("d", "AI", "k", "b", "brand-new_x", 1)])
    got = rs.build_chains(v).collect()
    assert [(r.paraphraser, r.family, r.T0, r.T1, r.T2, r.T3) for r in got] == \
        [("brand-new", "unknown", "t0", "new", "b", None)]


def test_chain_plan_adds_no_exchange_to_input_partitioned_by_document(spark, sf_small, capsys):
    from textdrift.plans.catalog import chains
    chains(spark, sf_small).explain()
    plan = capsys.readouterr().out
    assert len([x for x in plan.splitlines() if "Exchange" in x]) == 1     # the fixture's spread
    assert "Join" not in plan


def test_melt_skips_null_and_blank(spark):
    ch = spark.createDataFrame([("d", "k", "s", "p", "f", "a", None, "\n\t", "z")],
                               "dataset string, key string, source string, paraphraser string, "
                               "family string, T0 string, T1 string, T2 string, T3 string")
    got = sorted(r.stage for r in rs.melt_chains(ch).collect())
    assert got == ["T0", "T3"]
    assert F is not None

import os
import tempfile

import pytest
from pyspark.sql import types as T

from textdrift.sources import io


def write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_read_versions_checks(spark):
    d = tempfile.mkdtemp(prefix="textdrift-io-")
    write(os.path.join(d, "wp_paraphrased.csv"),
          'source,key,text,version_name,extra\nHuman,wp-1,"multi\nline, text",original,x\n'
          'Human,wp-1,NA,chatgpt,y\n')
    write(os.path.join(d, "xsum_paraphrased.csv"), "source,key,text\nHuman,x-1,t\n")
    df = io.read_versions(spark, d, ["wp"])
    rows = df.orderBy("version_name").collect()
    assert [r.text for r in rows] == [None, "multi\nline, text"]
    assert rows[0].dataset == "wp" and "extra" in df.columns
    with pytest.raises(ValueError):
        io.read_versions(spark, d, ["nope"])
    with pytest.raises(FileNotFoundError):
        io.read_versions(spark, d, ["eli5"])
    with pytest.raises(ValueError):
        io.read_versions(spark, d, ["xsum"])


def test_land_and_prune(spark):
    d = tempfile.mkdtemp(prefix="textdrift-land-")
    v = spark.createDataFrame([("s", "k", "t", "original", "wp"), ("s", "k", "t", "original", "cmv")],
                              "source string, key string, text string, version_name string, "
                              "dataset string")
    io.land_versions(v, os.path.join(d, "v"))
    got = io.read_landed(spark, os.path.join(d, "v"), ["wp"])
    assert got.count() == 1
    assert "PartitionFilters: [isnotnull(dataset" in got._jdf.queryExecution().executedPlan() \
        .toString() or "dataset IN" in got._jdf.queryExecution().executedPlan().toString()


def test_read_or_empty(spark):
    schema = T.StructType([T.StructField("stage", T.StringType()), T.StructField("score", T.DoubleType())])
    assert io.read_or_empty(spark, "/nonexistent/x.csv", schema).count() == 0
    d = tempfile.mkdtemp(prefix="textdrift-s4-")
    write(os.path.join(d, "a.csv"), "stage,other\nT1,1\n")
    assert io.read_or_empty(spark, os.path.join(d, "a.csv"), schema).count() == 0
    write(os.path.join(d, "b.csv"), "stage,score\nT1,0.5\n")
    r = io.read_or_empty(spark, os.path.join(d, "b.csv"), schema).first()
    assert r.score == 0.5


def test_columns_by_header_name_and_no_names(spark, tmp_path):
    write(str(tmp_path / "wp_paraphrased.csv"), "text,source,key,version_name\nthe text,Human,wp-1,original\n")
    row = io.read_versions(spark, str(tmp_path), ["wp"], schema=io.VERSION_SCHEMA).first()
    assert (row.text, row.source, row.key, row.version_name, row.dataset) == ("the text", "Human", "wp-1", "original", "wp")
    assert io.read_versions(spark, str(tmp_path), []).count() == 0


def test_reader_feeds_chains_features_entities_and_scores(spark, tmp_path):
    from textdrift.operators import entities as en, reshape as rs, similarity as sm, style as sy
    write(str(tmp_path / "wp_paraphrased.csv"),
          "source,key,text,version_name\nHuman,wp-1,Ann met 2 dogs. She ran.,original\n"
          "Human,wp-1,Ann met dogs.,chatgpt\nHuman,wp-1,later row,chatgpt\nHuman,wp-1,Ann ran,chatgpt_chatgpt\n")
    v = io.read_versions(spark, str(tmp_path), ["wp"])
    chain = rs.build_chains(v).first()
    assert (chain.T1, chain.T2, chain.T3) == ("Ann met dogs.", "Ann ran", None)
    assert sy.feature_chains(sy.style_features(v)).first().f_T0.sent_len_mean == 3.0
    assert sorted(en.entities_for_chains(v).first().ner_T0) == ["2", "ann", "she"]
    score = sm.score_chains(rs.build_chains(v)).first()
    assert 0 < score.rougeL_T2 < 1 and score.bleu_T3 is None


def test_own_mentions(spark):
    from textdrift.operators import entities as en
    ids = "dataset string, key string, source string, version_name string, seq long"
    v = spark.createDataFrame([("d", None, "s", "original", 0, "x"), ("d", "k", "s", "original", 0, "y")], ids + ", text string")
    m = spark.createDataFrame([("d", None, "s", "original", 0, " Paris "), ("d", None, "s", "original", 0, "paris")], ids + ", mention string")
    assert {r.key: r.ents for r in en.entity_sets(v, mentions=m).collect()} == {None: ["paris"], "k": []}


def test_csv_round_trip_keeps_texts(spark):
    d = tempfile.mkdtemp(prefix="textdrift-csv-")
    texts = [' lead and trail ', 'a "quoted", text', "two\nlines", "back\\slash", "", "NA", None, "ünï,漢"]
    v = spark.createDataFrame([("Human", f"k{i}", t, "original", i, "wp") for i, t in enumerate(texts)],
                              "source string, key string, text string, version_name string, seq long, dataset string")
    io.write_versions(v, d, ["wp"])
    got = {r.key: (r.text, r.seq, r.dataset) for r in io.read_versions(spark, d, ["wp"]).collect()}
    assert got == {f"k{i}": (None if t in ("", "NA") else t, i, "wp") for i, t in enumerate(texts)}


def test_scored_files_that_are_absent_are_passed_over(spark):
    d = tempfile.mkdtemp(prefix="textdrift-scored-")
    scored = spark.createDataFrame([("wp", "k", 0.5, None), ("cmv", "k", 0.25, 1.0)],
                                   "dataset string, key string, bleu_T1 double, rougeL_T3 double")
    io.write_scored(scored, d, ["wp"])
    rows = io.read_scored(spark, d).collect()
    assert [(r.dataset, r.bleu_T1, r.rougeL_T3) for r in rows] == [("wp", 0.5, None)]
    assert io.read_scored(spark, os.path.join(d, "nothing")).count() == 0


def test_landed_subset_prunes_partitions(spark, sf_small):
    from textdrift.plans.catalog import queries
    plan = queries()["s2_landed_subset"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [dataset" in plan

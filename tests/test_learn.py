import math

import pytest
from pyspark.sql import functions as F

from textdrift.operators import learn as le


def test_binary_metrics_by_hand(spark):
    rows = [("T1", "Human", "Human")] * 3 + [("T1", "Human", "AI")] + [("T1", "AI", "AI")] * 4 \
        + [("T1", "AI", "Human")] * 2
    df = spark.createDataFrame(rows, "stage string, label string, prediction string")
    r = le.binary_metrics(df).first()
    assert r.accuracy == pytest.approx(0.7)
    assert r.human_precision == pytest.approx(3 / 5) and r.human_recall == pytest.approx(3 / 4)
    assert r.ai_precision == pytest.approx(4 / 5) and r.ai_recall == pytest.approx(4 / 6)
    hf = 2 * 0.6 * 0.75 / 1.35
    af = 2 * 0.8 * (4 / 6) / (0.8 + 4 / 6)
    assert r.f1_macro == pytest.approx((hf + af) / 2)
    assert r.f1_weighted == pytest.approx((hf * 4 + af * 6) / 10)


def test_point_of_no_return(spark):
    def pnr(accs):
        df = spark.createDataFrame(list(zip(["T0", "T1", "T2", "T3"], accs)),
                                   "stage string, accuracy double")
        return le.point_of_no_return(df).first()[0]
    assert pnr([0.97, 0.60, 0.55, 0.50]) == "T2"
    assert pnr([0.97, 0.83, 0.82, 0.80]) is None


def test_tfidf_weights_by_formula(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc")], "id long, text string")
    vocab = le.fit_vocabulary(docs, "id", "text", max_features=None, min_df=1)
    terms = {r.term: r for r in vocab.collect()}
    assert set(terms) == {"aa", "bb", "cc", "aa bb", "bb aa", "aa cc"}
    assert terms["aa"].idf == pytest.approx(math.log(3 / 3) + 1)
    assert terms["bb"].idf == pytest.approx(math.log(3 / 2) + 1)
    vec = {r.id: r.features for r in le.transform_tfidf(docs, vocab, "id", "text").collect()}
    v1 = vec[1].toArray()
    assert math.isclose(sum(x * x for x in v1), 1.0, rel_tol=1e-9)
    w_aa = (1 + math.log(2)) * terms["aa"].idf
    w_bb = terms["bb"].idf
    assert v1[terms["aa"].idx] / v1[terms["bb"].idx] == pytest.approx(w_aa / w_bb)


def test_vocabulary_cut_is_deterministic(spark):
    docs = spark.createDataFrame([(1, "zz yy xx ww"), (2, "zz yy xx ww")], "id long, text string")
    v = le.fit_vocabulary(docs, "id", "text", max_features=2, min_df=2).collect()
    assert sorted(r.term for r in v) == ["ww", "xx"]     # ties on count broken by term


def test_multiclass_and_confusion(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "c"), ("c", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    m = {r.cls: r for r in le.multiclass_metrics(df).collect()}
    assert m["a"].precision == pytest.approx(0.5) and m["a"].recall == pytest.approx(0.5)
    assert m["b"].support == 1 and m["a"].accuracy == pytest.approx(0.6)
    cm = {(r.label, r.prediction): r.n for r in le.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[("a", "b")] == 1 and cm[("b", "a")] == 0


def test_logistic_regression_separates(spark):
    docs = spark.createDataFrame(
        [(i, ("apple banana " if i % 2 else "rocket engine ") * 3, float(i % 2)) for i in range(40)],
        "id long, text string, label double")
    vocab = le.fit_vocabulary(docs, "id", "text", max_features=50, min_df=1)
    x = le.transform_tfidf(docs, vocab, "id", "text")
    model = le.train_logistic(x, max_iter=100)
    assert model.summary.accuracy == 1.0


def test_macro_f1_of_one_class_and_family_size_by_chains(spark):
    from textdrift.operators import learn as le
    rows = [(i, "gpt", st, "Human", "Human", st == "T0" or i < 9) for i in range(12) for st in ("T0", "T2")]
    rows += [(i, "palm", "T0", "AI", "AI", True) for i in range(3)]
    pred = spark.createDataFrame(rows, "row_id long, family string, stage string, label string, prediction string, present boolean")
    got = {(r.family, r.stage): (r.n, r.f1_macro) for r in le.metrics_by_family(pred).collect()}
    assert got == {("gpt", "T0"): (12, 1.0), ("gpt", "T2"): (9, 1.0)}


def _chains(spark, n=60):
    """Human and AI chains whose words differ at T0; the rewrites mix them."""
    rows = []
    for i in range(n):
        human = i % 2 == 0
        own = "oak elm ash fir yew" if human else "iron zinc lead gold tin"
        text = f"{own} the common words {i % 7} of all"
        for p, family in (("chatgpt", "chatgpt"), ("palm", "palm")):
            mark = "alpha beta" if p == "palm" else "gamma delta"
            rows.append(("wp", f"k{i}", "Human" if human else "OpenAI", p, family, text, f"{text} {mark}",
                         None if i % 5 == 0 else "the common words of all", "common"))
    return spark.createDataFrame(rows, "dataset string, key string, source string, paraphraser string, "
                                       "family string, T0 string, T1 string, T2 string, T3 string")


def test_attribution_reaches_its_thresholds(spark):
    chains = _chains(spark)
    model, vocab, rows = le.train_attribution(chains, min_df=2)
    stages = {r.stage: r for r in le.binary_metrics(le.predict_stages(model, vocab, rows)).collect()}
    assert stages["T0"].accuracy == stages["T1"].accuracy == 1.0
    assert stages["T3"].accuracy <= 0.6 and stages["T2"].n < stages["T0"].n
    model, vocab, held = le.train_attribution(chains, min_df=2, holdout_by=("dataset", "key"))
    met = {r.stage: r for r in le.binary_metrics(le.predict_stages(model, vocab, held)).collect()}
    assert 0 < met["T0"].n < 120 and met["T0"].accuracy >= 0.95


def test_holdout_keeps_a_document_on_one_side(spark):
    chains = _chains(spark, 300)
    split = le.holdout_split(chains, percent=25)
    sides = split.groupBy("key").agg(F.countDistinct("split").alias("n")).where("n > 1")
    assert sides.count() == 0 and split.columns == [*chains.columns, "split"]
    test = split.where("split = 'test'").count() / 600
    assert 0.15 < test < 0.35
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    null = spark.createDataFrame([(None, None)], "dataset string, key string")
    assert le.holdout_split(null).first().split in ("train", "test")


def test_vectors_are_built_without_python(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "zz"), (3, None), (4, "aa cc")], "id long, text string")
    fit = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc")], "id long, text string")
    vocab = le.fit_vocabulary(fit, "id", "text", max_features=None, min_df=1)
    out = le.transform_tfidf(docs, vocab, "id", "text")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    vec = {r.id: r.features for r in out.collect()}
    assert vec[2].numNonzeros() == vec[3].numNonzeros() == 0 and {v.size for v in vec.values()} == {6}
    names = {r.idx: r.term for r in vocab.collect()}
    weights = {(r.id, r.term): r.weight for r in le.tfidf_weights(docs, vocab, "id").collect()}
    got = {(i, names[j]): float(x) for i, v in vec.items() for j, x in zip(v.indices.tolist(), v.values.tolist())}
    assert got.keys() == weights.keys() and all(math.isclose(got[k], weights[k]) for k in got)


def test_fingerprint_tells_rewriters_apart(spark):
    rows = _chains(spark).select(F.concat("key", F.lit("|"), "paraphraser").alias("row_id"), "family",
                                 F.col("T1").alias("text"), F.length("T1").cast("double").alias("size"))
    families = le.class_names(rows, "family")
    assert families == ["chatgpt", "palm"]
    vocab = le.fit_vocabulary(rows, "row_id", "text", max_features=50)
    x = le.fingerprint_features(rows.select("row_id", "text"), rows.select("row_id", "family", "size"),
                                "row_id", "text", vocab, ["size"])
    x = x.withColumn("label_idx", (F.col("family") == families[1]).cast("double"))
    model = le.train_fingerprint(x, num_trees=20, max_depth=5)
    right = model.transform(x).where(F.col("prediction") == F.col("label_idx")).count()
    assert right == 120
    top = le.feature_importance(model, ["size"] + [r.term for r in vocab.orderBy("idx").collect()], 5, spark)
    assert {r.feature for r in top.collect()} & {"alpha", "beta", "gamma", "delta", "alpha beta", "gamma delta"}


def test_pca_and_silhouette_separate_stages(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(f"T{i % 2}", Vectors.dense([10.0 * (i % 2) + 0.01 * i, 0.1 * (i % 3), 0.0])) for i in range(40)]
    df = spark.createDataFrame(rows, ["stage", "features"])
    projected, explained = le.pca_explained(df, k=2)
    assert explained == pytest.approx(1.0, abs=1e-6)
    assert le.silhouette_by_stage(projected) > 0.95

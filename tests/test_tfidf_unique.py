"""TF-IDF of rows whose ids do not repeat: no text is shuffled, the vectors are the same."""
import math

from textdrift.operators import learn as le


def test_rows_of_their_own_are_not_shuffled(spark, capsys):
    docs = spark.createDataFrame([(1, "Red red fox", "a"), (2, "red FOX", None), (3, None, "c"), (None, "fox", "d")],
                                 "id long, text string, tag string")
    want = le.fit_vocabulary(docs, "id", "text", None, 1)
    vocab = le.fit_vocabulary(docs, "id", "text", None, 1, one_row_each=True)
    assert sorted(vocab.collect()) == sorted(want.collect())
    found = le._texts_by_id(docs, "id", "text", True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    out = le.transform_tfidf(docs, want, "id", "text", one_row_each=True)
    assert out.columns == ["id", "tag", "features"]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.tag, r.features) for r in out.collect()}
    assert {i: t for i, (t, _) in got.items()} == {1: "a", 2: None, 3: "c", None: "d"}
    for r in le.transform_tfidf(docs.where("id is not null"), want, "id", "text").collect():
        assert r.features.indices.tolist() == got[r.id][1].indices.tolist()
        assert all(map(math.isclose, r.features.values.tolist(), got[r.id][1].values.tolist()))


def test_only_the_fitted_texts_are_stored_for_a_holdout(spark, monkeypatch):
    rows = [("wp", f"k{i}", "Human" if i % 2 else "OpenAI", "palm", "palm", f"{'oak' if i % 2 else 'tin'} words",
             "one", "two", "three") for i in range(80)]
    chains = spark.createDataFrame(rows, "dataset string, key string, source string, paraphraser string, family string, "
                                         "T0 string, T1 string, T2 string, T3 string")
    kept, keep = {}, le.stored
    monkeypatch.setattr(le, "stored", lambda df, name, *a: kept.setdefault(name, []).append(df.columns) or keep(df, name, *a))
    model, vocab, held = le.train_attribution(chains, holdout_by=("dataset", "key"), one_row_each=True)
    assert not {"T1", "T2", "T3"} & set(kept["attribution-rows"][0]) and {"T1", "T2", "T3"} <= set(held.columns)
    met = {r.stage: r for r in le.binary_metrics(le.predict_stages(model, vocab, held, one_row_each=True)).collect()}
    assert met["T0"].n == met["T3"].n == held.count() and met["T0"].accuracy == 1.0

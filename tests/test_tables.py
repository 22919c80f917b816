import math
import random
import re

import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textdrift.operators import clusters, counts, entities, gazetteer, reshape
from textdrift.plans.catalog import VK, chains, long_versions
from textdrift.plans.catalog_tables import stored_table


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line for line in plan.splitlines())


# tables bucketed by document

def test_stored_versions_plan_no_exchange(spark, sf_small):
    stored = stored_table(spark, long_versions(spark, sf_small), "versions")
    plain = long_versions(spark, sf_small)
    assert exchanges(reshape.build_chains(stored)) == 0
    assert exchanges(entities.retention_for_chains(entities.entities_for_chains(stored))) == 0
    assert exchanges(reshape.build_chains(plain)) > 0
    assert stored.exceptAll(plain.select(*stored.columns)).count() == 0 and stored.count() == plain.count()


def test_stored_chains_are_grouped_by_document_without_exchange(spark, sf_small):
    stored = stored_table(spark, chains(spark, sf_small), "chains")
    by_rewriter = stored.groupBy("dataset", "key", "source", "paraphraser").count()
    assert exchanges(stored.groupBy("dataset", "key", "source").count()) == 0 and exchanges(by_rewriter) == 0


def test_stored_null_keys_and_empty_tables(spark):
    schema = "dataset string, source string, key string, text string, version_name string, seq long"
    rows = [("d", None, "k", "t0", "original", 0), ("d", None, "k", "p", "palm", 1)]
    got = reshape.build_chains(stored_table(spark, spark.createDataFrame(rows, schema), "versions")).collect()
    assert [(r.source, r.T0, r.T1, r.T2) for r in got] == [(None, "t0", "p", None)]
    assert reshape.build_chains(stored_table(spark, spark.createDataFrame([], schema), "versions")).count() == 0


# gazetteer

PHRASES = [("New York", "PLACE"), ("new york times", "ORG"), ("York", "PLACE"), ("York", "PERSON"), ("  ", "ORG"),
           ("the times square", "PLACE"), ("lost", None), (None, "ORG"), ("NEW  YORK", "PLACE")]


def brute(texts, phrases):
    table = {}
    for p, label in phrases:
        form = " ".join(re.findall("[a-z0-9]+", (p or "").lower()))
        if form and label:
            table.setdefault(form, set()).add(label)
    out = []
    for i, text in texts:
        t = re.findall("[a-z0-9]+", (text or "").lower())
        spans = [(a, b) for a in range(len(t)) for b in range(a + 1, len(t) + 1) if " ".join(t[a:b]) in table]
        for a, b in spans:
            if not any((c, d) != (a, b) and c <= a and b <= d for c, d in spans):
                out += [(i, " ".join(t[a:b]), label, a) for label in table[" ".join(t[a:b])]]
    return sorted(out)


def texts():
    rng = random.Random(3)
    words = ["New", "York", "Times", "the", "square,", "in", "york.", "a"]
    fixed = [(0, None), (1, " \n"), (2, "From York to New York: The New York Times Square"), (3, "new-york")]
    return fixed + [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)]


@pytest.mark.parametrize("limit", [10, 0])
def test_longest_phrases(spark, monkeypatch, limit):
    monkeypatch.setattr(gazetteer, "BROADCAST_PHRASES", limit)
    phrases = spark.createDataFrame(PHRASES, "phrase string, label string")
    rows = spark.createDataFrame(texts(), "id long, text string")
    got = gazetteer.gazetteer_mentions(rows, phrases, ["id"])
    assert sorted(map(tuple, got.collect())) == brute(texts(), PHRASES)
    sets = entities.entity_sets_typed(rows, got, id_cols=["id"]).collect()
    assert len(sets) == len(texts())
    by_id = {r.id: {(e.text, e.label) for e in r.ents} for r in sets}
    assert by_id[0] == by_id[1] == set()
    assert by_id[2] == {("york", "PLACE"), ("york", "PERSON"), ("new york", "PLACE"), ("new york times", "ORG")}


def test_gazetteer_without_phrases_or_texts(spark):
    none = spark.createDataFrame([], "phrase string, label string")
    rows = spark.createDataFrame(texts(), "id long, text string")
    phrases = spark.createDataFrame(PHRASES, none.schema)
    assert gazetteer.gazetteer_mentions(rows, none, ["id"]).count() == 0
    assert gazetteer.gazetteer_mentions(rows.limit(0), phrases, ["id"]).count() == 0


def test_gazetteer_feeds_entity_sets_of_versions(spark, sf_small):
    v = long_versions(spark, sf_small)
    first = v.select(F.regexp_extract("text", r"^\w+ \w+", 0).alias("phrase"), F.lit("HEAD").alias("label")).where("phrase <> ''").limit(20)
    ner = entities.entities_for_chains(v, mentions=gazetteer.gazetteer_mentions(v, first, VK))
    assert ner.where(F.size("ner_T0") > 0).count() > 0


# silhouettes

def vectors(spark, n=300, clusters_of=5):
    rng = random.Random(1)
    rows = [(i, i % clusters_of, [rng.gauss(0.7 * (i % clusters_of), 1) for _ in range(4)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, c long, v array<double>")


def test_silhouette_against_pairs_and_the_evaluator(spark):
    rows, df = vectors(spark)
    got = {r.id: r.silhouette for r in clusters.silhouettes(df, "c", "v").collect()}

    def mean_distance(x, c, own):
        others = [y for j, d, y in rows if d == c and j != own]
        return sum(sum((a - b) ** 2 for a, b in zip(x, y)) for y in others) / len(others)
    for i, c, x in rows:
        a, b = mean_distance(x, c, i), min(mean_distance(x, d, i) for d in range(5) if d != c)
        assert math.isclose(got[i], (b - a) / max(a, b), abs_tol=1e-9)
    ml = df.select(array_to_vector("v").alias("features"), F.col("c").cast("double").alias("prediction"))
    assert math.isclose(sum(got.values()) / len(got), ClusteringEvaluator().evaluate(ml), abs_tol=1e-9)


def test_silhouette_of_odd_rows(spark):
    rows = [(1, "a", [0.0, 0.0]), (2, "b", [1.0, 1.0]), (3, "b", [1.0, 1.0]), (4, None, [1.0, 2.0]), (5, "a", None),
            (6, "b", [None, 1.0])]
    df = spark.createDataFrame(rows, "silhouette_id long, c string, v array<double>")
    assert sorted((r[0], r.silhouette) for r in clusters.silhouettes(df, "c", "v").collect()) == [(1, 0.0), (2, 1.0), (3, 1.0)]
    alone = clusters.silhouettes(df.where("c = 'b'"), "c", "v").collect()
    assert [r.silhouette for r in alone] == [None, None]
    assert clusters.silhouettes(df.limit(0), "c", "v").count() == 0


def test_too_many_clusters_are_refused(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MAX_CLUSTERS", 3)
    with pytest.raises(Exception, match="too many clusters"):
        clusters.silhouettes(vectors(spark, 20)[1], "c", "v").collect()


# sketches

def test_sketched_counts_are_within_their_error(spark):
    chain_rows = spark.range(60_000).selectExpr(
        "concat('d', id % 2) AS dataset", "concat('k', id % (20000 + 10000 * (id % 2))) AS key", "concat('p', id % 7) AS paraphraser")
    exact = {r.dataset: r for r in counts.corpus_stats(chain_rows).collect()}
    got = {r.dataset: r for r in counts.corpus_stats_sketched(chain_rows).collect()}
    assert set(got) == set(exact) == {"d0", "d1", "total"}
    for name, e in exact.items():
        assert got[name].n_chains == e.n_chains and got[name].n_paraphrasers == e.n_paraphrasers
        assert abs(got[name].n_documents - e.n_documents) <= 4 * 1.04 / 64 * e.n_documents
    assert "Expand" not in counts.corpus_stats_sketched(chain_rows)._jdf.queryExecution().toString()


def test_sketched_counts_skip_nulls_and_take_empty_tables(spark):
    rows = spark.createDataFrame([("a", None, "p"), ("a", "k", None), (None, "k", "p")],
                                 "dataset string, key string, paraphraser string")
    got = {r.dataset: tuple(r)[1:] for r in counts.corpus_stats_sketched(rows).collect()}
    assert got == {"a": (2, 1, 1), None: (1, 1, 1), "total": (3, 1, 1)}
    assert counts.corpus_stats_sketched(rows.limit(0)).count() == 0

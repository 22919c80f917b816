import pytest
from helpers import DOCS, documents, edge_pairs, near_classes, ordered, prose, repeats
from pyspark.sql import functions as F
from test_decontamination import brute

import corpus_pipeline
from textdrift.llm import decontamination, tables

BENCHMARK = [("b1", " ".join(f"bench{i}" for i in range(14))), ("b2", None), (None, "never there")]


def corpus():
    shared = prose(77, 60)
    out = edge_pairs() + [(100 + i, prose(i, 80)) for i in range(150)]
    out += [(300 + i, " ".join(w for w in prose(i, 6).split() for _ in range(14))) for i in range(60)]   # junk
    out += [(500 + i, prose(500, 200) + f" tail{i}") for i in range(5)]                                   # near copies
    out += [(600 + i, f"{prose(600 + i, 40)} {shared} {prose(650 + i, 30)}") for i in range(4)]           # passage
    out += [(700 + i, f"{prose(700 + i, 30)} {BENCHMARK[0][1]} {prose(750 + i, 30)}") for i in range(3)]
    return out + [(800, BENCHMARK[0][1] + " ok")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, corpus()).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 300 <= i < 400), 0) for i, _ in corpus() if i and 100 <= i < 400],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = tables.table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = tables.written(stage(spark, docs, sf_dir), f"test-{name}")
        out[name] = (before, docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "near_duplicates", "substrings", "decontamination", "packing"]
    for name, (_, after) in list(stages.items())[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in DOCS], name


def test_quality_rejects_junk_and_keeps_clean_documents(stages):
    kept = {i for i, _ in pairs(stages["quality"][1])}
    assert not kept & set(range(300, 360)) and set(range(100, 250)) <= kept


def test_near_duplicates_keep_one_of_each_class(stages):
    before, after = map(pairs, stages["near_duplicates"])
    classes = near_classes(before, size=5)
    expected = [i for i, n, *_ in classes if not n] + list({c: i for _, n, i, c in classes if n}.values())
    assert ordered((i,) for i, _ in after) == ordered((i,) for i in expected)
    assert set(after) <= set(before)


def test_substrings_cut_what_repeats(stages):
    before, after = map(pairs, stages["substrings"])
    assert ordered(after) == ordered((i, kept if removed else text)
                                     for (i, text), (_, _, removed, kept) in zip(before, repeats(before)))


def test_decontamination_removes_benchmark_passages(stages):
    before, after = map(pairs, stages["decontamination"])
    hit = {i: n_hit / n for i, n, n_hit, *_ in brute(before, BENCHMARK) if n_hit}
    assert set(hit) >= {700, 701, 702}
    assert {i for i, _ in after} == {i for i, _ in before} - {i for i, share in hit.items() if share > 0.5}
    assert not any(contaminated for *_, contaminated in brute(after, BENCHMARK))
    assert ordered(p for p in after if p[0] not in hit) == ordered(p for p in before if p[0] not in hit)


def test_packing_takes_every_kept_document(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.collect()} == {i for i, _ in pairs(before)}


def test_run_is_all_stages(spark, sf_dir, stages):
    columns = ["doc_id", "start", "length", "ids"]
    got = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").sum("length").collect()
    assert ordered(got) == ordered(stages["packing"][1].select(columns).groupBy("doc_id").sum("length").collect())


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_stages_keep_columns_with_any_name(spark, sf_dir):
    odd = ["kept_rows", "kept_id", "kept_hash", "removed_key", "hit_row", "hit_starts", "meta.url", "class"]
    docs = documents(spark, [(i, t) for i, t in corpus() if i != 6])
    for n, name in enumerate(odd):
        docs = docs.withColumn(name, F.lit(n))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = tables.written(stage(spark, docs, sf_dir), f"odd-{name}")
        assert after.columns == docs.columns, name
        values = after.select(*[tables.quoted(c) for c in odd]).distinct().collect()
        assert [tuple(r) for r in values] == [tuple(range(len(odd)))], name
    assert after.count() > 150


def test_benchmark_items_in_many_shards(spark):
    docs = documents(spark, corpus()).withColumn("hit_row", F.lit("x")).withColumn("meta.url", F.lit("y"))
    items = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    one, many = (decontamination.decontaminate(docs, items, shard_words=n) for n in (200_000, 3))
    assert one.columns == many.columns == docs.columns and ordered(one.collect()) == ordered(many.collect())

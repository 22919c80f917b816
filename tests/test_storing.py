"""What is written once and how: CSV and tables of versions, scored chains, distinct values."""
import glob

from pyspark.sql import functions as F

from textdrift.plans import catalog, catalog_tables
from textdrift.session import ensure_checkpoint_dir
from textdrift.sources import fixtures as fx
from textdrift.sources import io


def test_csv_is_compressed_and_read_whole(spark, tmp_path):
    rows = [("wp", "s", f"k{i}", 'a "quoted"\nline, ' * 50, "original") for i in range(40)]
    v = spark.createDataFrame(rows, "dataset string, source string, key string, text string, version_name string")
    io.write_versions(v, str(tmp_path), ["wp"])
    files = glob.glob(f"{tmp_path}/wp_paraphrased.csv/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files)
    got = io.read_versions(spark, str(tmp_path), ["wp"]).select(*v.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_scored_chains_are_computed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        calls.add(1)
        return float(x)
    rows = [(d, f"k{i}") for d in ("wp", "xsum", "eli5") for i in range(5)]
    ensure_checkpoint_dir(spark)
    scored = spark.createDataFrame(rows, "dataset string, key string").withColumn("rouge1_T1", score(F.substring("key", 2, 1)))
    io.write_scored(scored, str(tmp_path), ["wp", "xsum"])
    got = io.read_scored(spark, str(tmp_path))
    assert got.count() == 10 and calls.value <= 15
    assert {r.rouge1_T1 for r in got.collect()} == {0.0, 1.0, 2.0, 3.0, 4.0}


def test_versions_are_dealt_to_buckets_as_documents(spark, sf_small):
    t = catalog_tables._stored_versions(spark, sf_small)
    per_document = t.groupBy("dataset", "key", "source").count()
    assert "Exchange" not in per_document._jdf.queryExecution().executedPlan().toString()
    want = fx.versions(spark, sf_small)
    assert t.select(*want.columns).exceptAll(want).isEmpty() and t.count() == want.count()
    files = [f.rsplit("/", 1)[1] for f in t.inputFiles()]
    assert len(files) == len({f.split("_")[1] for f in files}) and all("zstd" in f for f in files)     # one file a bucket


def test_distinct_values_read_no_text_and_the_chains_once(spark, sf_small):
    r11 = catalog.QUERIES["r11_distinct_values"](spark, sf_small)
    plan = r11._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "text" not in plan
    assert r11.count() == 19

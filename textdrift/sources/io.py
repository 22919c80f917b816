"""Reading and writing version, chain and metric tables.

The reference keeps one CSV per dataset. Here a version table is ONE DataFrame with a
``dataset`` column: CSVs are read with an explicit schema (never inferred), checked for the
required columns, and landed once as Parquet partitioned by ``dataset`` (multi-line CSV does
not split, Parquet does; later reads prune partitions and push filters down).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textdrift.constants import DATASETS, REQUIRED_COLUMNS, WORKING_DATASETS
from textdrift.session import stored

VERSION_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in REQUIRED_COLUMNS])

# tokens pandas' read_csv reads as missing by default (Spark has one nullValue only)
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def dataset_file(name: str) -> str:
    return f"{name}_paraphrased.csv"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _null_tokens(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isin(*NA_TOKENS), F.lit(None)).otherwise(F.col(c))
                           for c in cols})


def _unreadable(spark: SparkSession, root: str, names: list[str]) -> tuple[list[str], list[str]]:
    """(names outside the known datasets, paths without a file)."""
    known = [n for n in names if n in DATASETS]
    paths = [os.path.join(root, dataset_file(n)) for n in known]
    return [n for n in names if n not in known], [p for p in paths if not _exists(spark, p)]


def read_versions(spark: SparkSession, root: str, names=None, schema: T.StructType | None = None
                  ) -> DataFrame:
    """Read the version CSVs of ``names`` (default: all datasets) as one DataFrame.

    All names are checked before anything is read: unknown ones raise ValueError, absent files
    FileNotFoundError, headers that lack required columns ValueError. Columns are found by their
    header names; all are strings unless ``schema`` gives a column another type. A column ``seq``
    with the order of the rows in their file is added unless the file has one. No names give an
    empty table.
    """
    names = list(DATASETS if names is None else names)
    strange, absent = _unreadable(spark, root, names)
    if strange:
        raise ValueError(f"not among the datasets {DATASETS}: {strange}")
    if absent:
        raise FileNotFoundError(f"no such version files: {absent}")
    reader = spark.read.option("header", True)
    headers = {n: reader.csv(os.path.join(root, dataset_file(n))).columns for n in names}
    lacking = {n: sorted(set(REQUIRED_COLUMNS) - set(h)) for n, h in headers.items() if not set(REQUIRED_COLUMNS) <= set(h)}
    if lacking:
        raise ValueError(f"required columns are absent, by dataset: {lacking}")
    types = {f.name: f.dataType for f in (schema.fields if schema else ())}
    out = spark.createDataFrame([], T.StructType([*VERSION_SCHEMA.fields, T.StructField("seq", T.LongType()),
                                                  T.StructField("dataset", T.StringType())]))
    for name, header in headers.items():
        strings = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
        df = (reader.schema(strings).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
              .csv(os.path.join(root, dataset_file(name))))
        df = _null_tokens(df, header)
        df = df.select(*[F.col(c).cast(types.get(c, T.StringType())) for c in header])
        if "seq" not in header:
            df = df.withColumn("seq", F.monotonically_increasing_id())
        out = out.unionByName(df.withColumn("seq", F.col("seq").cast("long")).withColumn("dataset", F.lit(name)),
                              allowMissingColumns=True)
    return out


def _write_csv(df: DataFrame, path: str) -> None:
    """As the readers here expect it: a header, doubled quotes, white space kept. Compressed, since multi-line CSV does
    not split anyway; Spark's readers tell by the file names."""
    (df.write.mode("overwrite").option("header", True).option("compression", "gzip").option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_versions(versions: DataFrame, root: str, names=None) -> None:
    """One CSV folder for each dataset of ``names`` (default: all), as ``read_versions`` reads it."""
    for name in (DATASETS if names is None else names):
        _write_csv(versions.where(F.col("dataset") == name).drop("dataset"), os.path.join(root, dataset_file(name)))


def read_working(spark: SparkSession, root: str) -> DataFrame:
    """The working subset of datasets."""
    return read_versions(spark, root, WORKING_DATASETS)


def land_versions(versions: DataFrame, path: str) -> None:
    """Write a version table once as Parquet partitioned by dataset (splittable, prunable)."""
    versions.write.mode("overwrite").partitionBy("dataset").parquet(path)


def read_landed(spark: SparkSession, path: str, names=None) -> DataFrame:
    """Read a landed version (or chain) table; ``names`` becomes a partition filter."""
    df = spark.read.parquet(path)
    return df.where(F.col("dataset").isin(*names)) if names is not None else df


def write_chains(chains: DataFrame, path: str) -> None:
    """S3: chain table as Parquet partitioned by dataset (counts are C5)."""
    chains.write.mode("overwrite").partitionBy("dataset").parquet(path)


def store_by_document(df: DataFrame, table: str, path: str, buckets: int, sort=(), dealt: bool = False) -> DataFrame:
    """A version or chain table, stored as ``table`` under ``path`` in ``buckets`` buckets of
    (dataset, key, source) and read back.

    Whatever groups the stored table by document, or by document and more, needs no exchange. Each
    bucket is one file; choose ``buckets`` so that one fits a task (bytes of all texts / 128 MB).
    The shuffle here is the only one; it is paid once for all later reads. ``dealt`` says that the rows are already
    partitioned so, by these keys into ``buckets`` parts: nothing is shuffled then. Versions of a document lie
    together, which zstd makes small.
    """
    keys = ["dataset", "key", "source"]
    rows = df if dealt else df.repartition(buckets, *keys)
    writer = rows.write.format("parquet").mode("overwrite").option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, *keys).sortBy(*keys, *sort).saveAsTable(table)
    return df.sparkSession.table(table)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType,
                  fmt: str = "csv") -> DataFrame:
    """A result table, or an empty frame when it is absent or lacks a required column."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    if not set(schema.fieldNames()) <= set(df.columns):
        return spark.createDataFrame([], schema)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_scored(spark: SparkSession, root: str, names=None, suffix: str = "_chains_scored.csv"
                ) -> DataFrame:
    """Union of the per-dataset scored chain files that exist, tagged with ``dataset``."""
    frames = []
    for name in (DATASETS if names is None else names):
        path = os.path.join(root, f"{name}{suffix}")
        if _exists(spark, path):
            frames.append(spark.read.option("header", True).option("inferSchema", False)
                          .option("multiLine", True).option("escape", '"').csv(path)
                          .withColumn("dataset", F.lit(name)))
    if not frames:
        return spark.createDataFrame([], "dataset string")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    score_cols = [c for c in out.columns if c.split("_")[0] in
                  ("bleu", "rouge1", "rouge2", "rougeL", "bertscore")]
    return out.withColumns({c: F.col(c).cast("double") for c in score_cols})


def write_scored(scored: DataFrame, root: str, names=None, suffix: str = "_chains_scored.csv") -> None:
    """One CSV folder of scored chains for each dataset of ``names``, as ``read_scored`` reads it."""
    names = list(DATASETS if names is None else names)
    scored = stored(scored.where(F.col("dataset").isin(*names)), "scored")      # small rows, computed once for all files
    for name in names:
        _write_csv(scored.where(F.col("dataset") == name).drop("dataset"), os.path.join(root, f"{name}{suffix}"))


def write_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A metric table (tens to hundreds of rows) as one file."""
    w = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)

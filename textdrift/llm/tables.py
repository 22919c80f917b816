"""Tables of a query and intermediate tables on shared storage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textdrift.session import ensure_checkpoint_dir


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder, and read back: a cut of
    the lineage that survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.folder = path
    return back


def forget(df: DataFrame) -> None:
    """Deletes a table that ``written`` returned and that nothing will read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str):
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(rows: DataFrame, task, schema) -> DataFrame:
    """``rows.mapInArrow(task, schema)`` for columns of any name (Spark itself takes no dots)."""
    names = rows.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return task(batch.rename_columns(names) for batch in batches)

    return rows.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, schema)


def free_prefix(prefix: str, *columns: list[str]) -> str:
    """``prefix``, lengthened until no column's name starts with it."""
    while any(c.lower().startswith(prefix) for names in columns for c in names):
        prefix = "_" + prefix
    return prefix


def remainder(doc_id, m: int):
    """crc32(doc_id as text) mod m; null doc_id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m).cast("int")

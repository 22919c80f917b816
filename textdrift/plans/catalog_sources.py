"""Queries that write tables and read them back: S1-S6 on Spark's own file formats.

They write into the checkpoint folder (shared storage on a cluster), a folder of its own for each
call, and return what the readers make of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textdrift.constants import LATER_STAGES, STAGES, WORKING_DATASETS
from textdrift.operators import counts as co
from textdrift.operators import derive as de
from textdrift.plans import sql as S
from textdrift.plans.catalog import CHS, QUERIES, chains, long_versions, register
from textdrift.session import ensure_checkpoint_dir
from textdrift.sources import fixtures as fx
from textdrift.sources import io

_NA = ", ".join(S.q(x) for x in io.NA_TOKENS)
_WORKING = ", ".join(S.q(d) for d in WORKING_DATASETS)


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _read_back(column: str) -> str:
    """A text after CSV: missing-value tokens are NULL."""
    return f"CASE WHEN {column} IN ({_NA}) THEN NULL ELSE {column} END"


@register("s1_read_versions", S.with_(S.versions_cte(), S.long_cte()) + f"""
SELECT dataset, source, key, version_name, seq, stage, paraphraser, family, {_read_back('text')} AS text FROM lv""")
def s1_read_versions(spark, sf):
    """One CSV for each dataset, read by header names with the checks of S1."""
    root = _folder(spark, "csv")
    io.write_versions(fx.versions(spark, sf), root)
    return de.with_version_columns(io.read_versions(spark, root)).select(
        "dataset", "source", "key", "version_name", "seq", "stage", "paraphraser", "family", "text")


@register("s2_landed_subset", S.with_(S.versions_cte(), S.long_cte()) + f"""
SELECT dataset, stage, count(*) AS n FROM lv WHERE dataset IN ({_WORKING}) GROUP BY dataset, stage""")
def s2_landed_subset(spark, sf):
    """The working subset of landed Parquet: the other datasets' partitions are not read."""
    path = _folder(spark, "landed")
    io.land_versions(long_versions(spark, sf), path)
    return io.read_landed(spark, path, WORKING_DATASETS).groupBy("dataset", "stage").agg(F.count(F.lit(1)).alias("n"))


@register("s3_chain_table", S.F1_CHAINS + f"SELECT {CHS}, family, {', '.join(STAGES)} FROM chains")
def s3_chain_table(spark, sf):
    """Chains written as Parquet by dataset and read back."""
    path = _folder(spark, "chains")
    io.write_chains(chains(spark, sf), path)
    return io.read_landed(spark, path).select(*CHS.split(", "), "family", *STAGES)


def _s5_sql() -> str:
    from textdrift.plans.catalog import ORACLE
    cols = ", ".join(f"rouge1_{s}" for s in LATER_STAGES)
    return f"SELECT {CHS}, family, {cols} FROM ({ORACLE['m2_rouge1']}) WHERE dataset IN ({_WORKING})"


@register("s5_read_scored", _s5_sql())
def s5_read_scored(spark, sf):
    """Scored chains of some datasets as CSV; datasets without a file are passed over."""
    root = _folder(spark, "scored")
    io.write_scored(QUERIES["m2_rouge1"](spark, sf), root, WORKING_DATASETS)
    return io.read_scored(spark, root).select(*CHS.split(", "), "family", *[f"rouge1_{s}" for s in LATER_STAGES])


@register("s6_metric_table", S.F1_CHAINS + "SELECT family, count(*) AS n_chains FROM chains GROUP BY family")
def s6_metric_table(spark, sf):
    """A metric table as one file, read back with a schema."""
    path = _folder(spark, "metrics")
    io.write_metrics(co.chain_counts(chains(spark, sf), "family"), path)
    return io.read_or_empty(spark, path, T.StructType([T.StructField("family", T.StringType()),
                                                       T.StructField("n_chains", T.LongType())]))

"""The corpus pipeline over ``documents``: five stages in order, each written as Parquet and reread.

1. quality: documents that the classifier rejects go (learnt from ``labels``).
2. near_duplicates: of each group of near duplicates one document stays (shingles of five words,
   similarity 0.8 or more).
3. substrings: words inside windows that recur anywhere in what is left are cut out.
4. decontamination: benchmark passages are cut out; documents that mostly consist of them go.
5. packing: what is left is packed into training sequences.

All but the last return the columns of ``documents``. Null columns, empty tables and further
columns are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textdrift.llm import decontamination, near_duplicates, packing, quality, substrings, tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rows whose score is at least the threshold."""
    forest = quality.train(docs, tables.table(spark, sf_dir, "labels"))
    return quality.score(docs, forest, keep_rows=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row of each group of near duplicates."""
    tables.importable(spark)
    return near_duplicates.without_near_duplicates(docs)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts without the words of recurring windows."""
    tables.importable(spark)
    return substrings.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: texts without benchmark passages."""
    return decontamination.decontaminate(docs, tables.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces of the documents in training sequences, with their token ids."""
    tables.importable(spark)
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("substrings", cut_substrings),
          ("decontamination", decontaminate), ("packing", pack)]

#: Trained trees, MinHash and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; returns the last stage's rows."""
    docs = tables.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries opN_<name> of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textdrift.llm import (collocations, decontamination, extraction, hard_negatives, language, language_model, licenses,
                           near_duplicates, packing, quality, rules, separators, sql, substrings)
from textdrift.llm.tables import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows cover."""
    return substrings.repeated_words(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files of the whole table."""
    return separators.token_counts(table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by a model of those that are not held out."""
    return language_model.score_corpus(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return rules.judge(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with the checksum of its ids."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language of ``documents``."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality, op2_decontamination, op3_licenses, op4_substrings, op5_token_counts, op6_language_model,
        op7_quality_rules, op8_packing, op9_language, op10_minhash, op11_collocations, op12_hard_negatives,
        op13_extraction)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": sql.decontamination_sql(), "op3_licenses": sql.licenses_sql(),
            "op4_substrings": sql.substrings_sql(), "op7_quality_rules": sql.rules_sql(),
            "op10_minhash": sql.near_duplicates_sql(), "op11_collocations": sql.collocations_sql(),
            "op12_hard_negatives": sql.hard_negatives_sql()}

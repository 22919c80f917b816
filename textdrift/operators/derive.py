"""Row-level derivations on version and chain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.functions import text as tx


def with_version_columns(versions: DataFrame) -> DataFrame:
    """Add ``stage``, ``paraphraser`` and ``family`` from ``version_name``."""
    return versions.withColumns({
        "stage": tx.stage_of("version_name"),
        "paraphraser": tx.paraphraser_of("version_name"),
        "family": tx.family_of(tx.paraphraser_of("version_name")),
    })


def preprocess(versions: DataFrame, stopwords=None, text_col: str = "text") -> DataFrame:
    """Add ``cleaned_text`` and ``no_stop_text``."""
    cleaned = versions.withColumn("cleaned_text", tx.clean_text(text_col))      # cleaned once
    return cleaned.withColumn("no_stop_text", tx.remove_stopwords("cleaned_text", stopwords))


def text_stats(pre: DataFrame, keep=()) -> DataFrame:
    """Word counts of the raw, cleaned and stopword-free text, distinct cleaned words.

    ``keep`` lists key columns carried along (the reference relies on row position instead).
    The cleaned texts hold single spaces between words, so their words are counted by the spaces.
    """
    return pre.select(
        *keep,
        tx.word_count("text").alias("word_count"),
        tx.spaced_word_count("cleaned_text").alias("cleaned_word_count"),
        tx.spaced_word_count("no_stop_text").alias("no_stop_word_count"),
        tx.unique_word_count("cleaned_text").alias("unique_words"),
    )


def valid_pairs(chains: DataFrame, stage: str) -> DataFrame:
    """P10: chains whose T0 and ``stage`` text are both present."""
    return chains.where(F.col("T0").isNotNull() & F.col(stage).isNotNull())


def filter_chains(chains: DataFrame, datasets=None, families=None, paraphrasers=None) -> DataFrame:
    """Membership filters (pushed to the scan when the table is partitioned by them)."""
    out = chains
    if datasets is not None:
        out = out.where(F.col("dataset").isin(*datasets))
    if families is not None:
        out = out.where(F.col("family").isin(*families))
    if paraphrasers is not None:
        out = out.where(F.col("paraphraser").isin(*paraphrasers))
    return out


def round_metrics(df: DataFrame, cols, places: int = 4, half_even: bool = True) -> DataFrame:
    """Round reported metrics (half-even like pandas by default)."""
    fn = F.bround if half_even else F.round
    return df.withColumns({c: fn(F.col(c), places) for c in cols})

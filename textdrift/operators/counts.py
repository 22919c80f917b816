"""Corpus counts (C1-C6): all are partial + final hash aggregates with tiny keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.constants import STAGES
from textdrift.operators.quantiles import quantiles


def stage_counts(long: DataFrame) -> DataFrame:
    """Rows per dataset x stage, one column per stage (0 when a stage is missing)."""
    piv = long.groupBy("dataset").pivot("stage", STAGES).count()
    return piv.select("dataset", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s)
                                   for s in STAGES])


def word_count_distribution(stats: DataFrame, col: str = "word_count") -> DataFrame:
    """Quartiles (exact, linear interpolation) and mean of a count per dataset x stage."""
    by = ["dataset", "stage"]
    q = quantiles(stats, by, col, (0.25, 0.5, 0.75)).select(*by, "quantiles")
    means = stats.groupBy(*by).agg(F.avg(col).alias("mean"))
    same = F.lit(True)
    for c in by:
        same &= means[c].eqNullSafe(q[c])
    return means.join(q, same, "left").select(
        *[means[c] for c in by], *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "mean")


def vocabulary_by_stage(stats: DataFrame) -> DataFrame:
    """Mean word count and mean stopword-free count per dataset x stage, and their gap."""
    return stats.groupBy("dataset", "stage").agg(
        F.avg("word_count").alias("mean_word_count"),
        F.avg("no_stop_word_count").alias("mean_no_stop_count")) \
        .withColumn("stopword_gap", F.col("mean_word_count") - F.col("mean_no_stop_count"))


def chain_counts(chains: DataFrame, by: str) -> DataFrame:
    """C4: chains per value of ``by``, largest first."""
    return chains.groupBy(by).agg(F.count(F.lit(1)).alias("n_chains")) \
        .orderBy(F.desc("n_chains"), by)


def corpus_stats(chains: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """Chains, distinct paraphrasers and documents per dataset, plus a total line.

    With ``long`` also T0 documents and total version rows (the paper's corpus table).
    ``ROLLUP(dataset)`` gives the per-dataset rows and the total in one aggregate.
    """
    c = chains.rollup("dataset").agg(
        F.count(F.lit(1)).alias("n_chains"),
        F.countDistinct("paraphraser").alias("n_paraphrasers"),
        F.countDistinct("key").alias("n_documents"),
        F.grouping_id().alias("_g"))
    c = c.select(F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col("dataset"))
                 .alias("dataset"), "n_chains", "n_paraphrasers", "n_documents")
    if long is None:
        return c
    v = long.rollup("dataset").agg(
        F.count_if(F.col("stage") == "T0").alias("t0_docs"),
        F.count(F.lit(1)).alias("total_rows"), F.grouping_id().alias("_g"))
    v = v.select(F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col("dataset"))
                 .alias("dataset"), "t0_docs", "total_rows")
    return c.join(v, "dataset", "full")


def corpus_stats_sketched(chains: DataFrame, lg_k: int = 12) -> DataFrame:
    """C5 by mergeable sketches: the distinct counts are HyperLogLog estimates (relative standard
    error about 1.04 / sqrt(2^lg_k)), ``n_chains`` is exact.

    Chains are read once and aggregated to one sketch for each dataset; the total line merges
    those few sketches, so no row of the corpus is expanded for it.
    """
    per = chains.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("paraphraser", lg_k).alias("p"),
        F.hll_sketch_agg("key", lg_k).alias("d"))
    lines = per.select("n", "p", "d", F.explode(F.array(
        F.struct(F.lit(0).alias("_g"), F.col("dataset").alias("dataset")),
        F.struct(F.lit(1).alias("_g"), F.lit("total").alias("dataset")))).alias("_l"))
    merged = lines.groupBy("_l").agg(F.sum("n").alias("n_chains"), F.hll_union_agg("p").alias("p"),
                                     F.hll_union_agg("d").alias("d"))
    return merged.select("_l.dataset", "n_chains", F.hll_sketch_estimate("p").alias("n_paraphrasers"),
                         F.hll_sketch_estimate("d").alias("n_documents"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Count and percent share of each value (share = count / total over all values)."""
    cnt = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()              # one number, computed once by a subquery
    return cnt.select(col, "n", (F.col("n") * 100.0 / total).alias("percent"))

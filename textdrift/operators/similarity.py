"""Pair similarity of every later version against its original.

Overlap metrics (BLEU-2, ROUGE-1/2/L) are counted inside one Arrow task over chain rows
(``functions/overlap.py``): the texts of a slice of chains are tokenised word by word (a known word
and a shared T0 once), n-grams are hashed and looked up among those of T0, and only the counts that
the metrics need come back. The metric
formulas are Spark expressions on these counts. Nothing is shuffled.

Formulas: BLEU-2 with smoothing method 1 (Papineni 2002; Chen & Cherry 2014),
ROUGE-N / ROUGE-L F-measure (Lin 2004).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textdrift.constants import LATER_STAGES, METRIC_LABELS, STAGES
from textdrift.functions import overlap
from textdrift.functions import text as tx
from textdrift.functions import vectors as vx
from textdrift.operators.reshape import CHAIN_KEYS

ALL_METRICS = ("bleu", "rouge1", "rouge2", "rougeL")


def _f(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def overlap_counts(chains: DataFrame, metrics, keep=()) -> DataFrame:
    """Chain keys, the columns ``keep`` and the counts of ``overlap.count_columns`` for every chain."""
    names, own = overlap.count_columns(metrics), [*CHAIN_KEYS, *keep]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = overlap.Words()
        for batch in batches:
            for a, b, counts in overlap.chain_counts(batch, metrics, words):
                kept = [batch.column(i)[a:b] for i in range(len(own))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(counts[n], pa.int64()) for n in names],
                                                 names=own + names)

    x = chains.select(*[F.col(k).cast("string") for k in CHAIN_KEYS], *keep, *STAGES)
    schema = ", ".join([f"{k} {x.schema[k].dataType.simpleString()}" for k in own] + [f"{n} long" for n in names])
    return x.mapInArrow(task, schema)


def score_chains(chains: DataFrame, metrics=ALL_METRICS, keep=()) -> DataFrame:
    """M5: chain columns, the columns ``keep`` + ``<metric>_<stage>`` for stages T1..T3 (NULL when T0 or Tn is absent).

    The counts of a chain come from its own row, so the operator plans no exchange, whether the
    chains come from R1 or from a stored table.
    """
    metrics = [m for m in ALL_METRICS if m in set(metrics)]
    out = [*CHAIN_KEYS, tx.family_of("paraphraser").alias("family"), *keep]
    for i, st in zip((1, 2, 3), LATER_STAGES):
        valid = (F.col("has0") > 0) & (F.col(f"has{i}") > 0)
        if "bleu" in metrics:
            hyp, ref = F.col(f"n_bleu{i}"), F.col("n_bleu0")
            p1 = F.col(f"m_bleu1{i}") / F.greatest(hyp, F.lit(1))
            hyp2 = F.greatest(hyp - 1, F.lit(0))
            p2 = F.when(F.col(f"m_bleu2{i}") > 0, F.col(f"m_bleu2{i}") / F.greatest(hyp2, F.lit(1))) \
                .otherwise(F.lit(0.1) / F.greatest(hyp2, F.lit(1)))
            bp = F.when(hyp > ref, F.lit(1.0)).otherwise(F.exp(1 - ref / hyp))
            bleu = F.when(F.col(f"m_bleu1{i}") == 0, F.lit(0.0)).otherwise(bp * F.sqrt(p1 * p2))
            out.append(F.when(valid, bleu).alias(f"bleu_{st}"))
        for m, off in (("rouge1", 0), ("rouge2", 1)):
            if m in metrics:
                hyp = F.greatest(F.col(f"n_rouge{i}") - off, F.lit(0))
                ref = F.greatest(F.col("n_rouge0") - off, F.lit(0))
                match = F.col(f"m_{m}{i}")
                out.append(F.when(valid, _f(match / F.greatest(hyp, F.lit(1)), match / F.greatest(ref, F.lit(1))))
                           .alias(f"{m}_{st}"))
        if "rougeL" in metrics:
            lcs, hyp, ref = F.col(f"lcs{i}"), F.col(f"n_rouge{i}"), F.col("n_rouge0")
            p = F.when(hyp > 0, lcs / hyp).otherwise(F.lit(0.0))
            r = F.when(ref > 0, lcs / ref).otherwise(F.lit(0.0))
            out.append(F.when(valid, _f(p, r)).alias(f"rougeL_{st}"))
    return overlap_counts(chains, metrics, keep).select(*out)


def bleu2(chains: DataFrame) -> DataFrame:
    """M1."""
    return score_chains(chains, ["bleu"])


def rouge_n(chains: DataFrame, n: int) -> DataFrame:
    """M2 (n=1), M3 (n=2)."""
    return score_chains(chains, [f"rouge{n}"])


def rouge_l(chains: DataFrame) -> DataFrame:
    """M4."""
    return score_chains(chains, ["rougeL"])


def scores_long(scored: DataFrame, prefixes=ALL_METRICS + ("bertscore",)) -> DataFrame:
    """Wide ``<metric>_<stage>`` columns -> long (ids..., stage, metric, score)."""
    score_cols = [c for c in scored.columns
                  if "_" in c and c.rsplit("_", 1)[0] in prefixes and c.rsplit("_", 1)[1] in STAGES]
    ids = [c for c in scored.columns if c not in score_cols]
    long = scored.unpivot(ids, score_cols, "_col", "score")
    return long.select(*ids, F.split("_col", "_").getItem(1).alias("stage"),
                       F.split("_col", "_").getItem(0).alias("metric"), "score")


def mean_scores_by_stage(scored: DataFrame) -> DataFrame:
    """(stage, metric label, mean score) for the metric columns present."""
    labels = F.create_map(*[F.lit(x) for kv in {**METRIC_LABELS, "bertscore": "BERTSCORE-F1"}.items()
                            for x in kv])
    long = scores_long(scored)
    return (long.groupBy("stage", "metric").agg(F.avg("score").alias("score"))
            .select("stage", labels[F.col("metric")].alias("metric"), "score"))


def metric_by_stage(scored: DataFrame, by=("dataset",), places: int | None = 4) -> DataFrame:
    """Metric x stage matrix of means for each group of ``by``: (by..., metric, T1, T2, T3)."""
    long = scores_long(scored)
    out = long.groupBy(*by, "metric").pivot("stage", LATER_STAGES).agg(F.avg("score"))
    if places is not None:
        out = out.withColumns({s: F.bround(F.col(s), places) for s in LATER_STAGES})
    return out


def decay_curves(scored: DataFrame, by: str = "family") -> DataFrame:
    """(by, metric, T0 = 1.0, mean T1, mean T2, mean T3) of all metrics present, in one pass."""
    piv = scores_long(scored).groupBy(by, "metric").pivot("stage", LATER_STAGES).agg(F.avg("score"))
    return piv.select(by, "metric", F.lit(1.0).alias("T0"), *LATER_STAGES)


def decay_curve(scored: DataFrame, metric: str, by: str = "family") -> DataFrame:
    """[1.0, mean T1, mean T2, mean T3] of one metric per group."""
    return decay_curves(scored.select(*[c for c in scored.columns if c.rsplit("_", 1)[-1] not in STAGES
                                        or c.rsplit("_", 1)[0] == metric]), by).drop("metric")


# ---------------------------------------------------------------------------------------------
# Stored embeddings
# ---------------------------------------------------------------------------------------------

def embedding_cosine(pairs: DataFrame, ref_col: str = "ref_vec", hyp_col: str = "hyp_vec") -> DataFrame:
    """M7: row-wise cosine of two embedding columns (NULL when a side is missing or zero)."""
    return pairs.withColumn("cosine", vx.cosine(ref_col, hyp_col))


def mean_embedding_cosine_by_stage(pairs: DataFrame, missing: str = "skip") -> DataFrame:
    """M8: mean cosine per (dataset, stage) and over all datasets, pivoted on stage; T0 = 1.0.

    ``missing='skip'`` leaves pairs without a rewrite out; ``'empty'`` counts them as 0.
    """
    cos = embedding_cosine(pairs.where(F.col("ref_vec").isNotNull()))
    if missing == "skip":
        cos = cos.where(F.col("hyp_vec").isNotNull())
    else:
        cos = cos.withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    sets = cos.groupingSets([["dataset", "stage"], ["stage"]], "dataset", "stage") \
        .agg(F.avg("cosine").alias("score"), F.grouping_id().alias("_gid"))
    sets = sets.withColumn("dataset", F.when(F.col("_gid") == 2, F.lit("all_combined"))
                           .otherwise(F.col("dataset")))
    piv = sets.groupBy("dataset").pivot("stage", LATER_STAGES).agg(F.first("score"))
    return piv.select("dataset", F.lit(1.0).alias("T0"), *LATER_STAGES)


MATCH_BLOCK = 512


def greedy_match_f1(token_vectors: DataFrame, pairs: DataFrame, block: int = MATCH_BLOCK) -> DataFrame:
    """M9: BERTScore-style greedy matching of token vectors, per text pair.

    ``token_vectors``: (text_id, pos, vec); ``pairs``: (ref_id, hyp_id, ...). Each token is
    matched to its most similar token on the other side (cosine); precision = mean over
    hypothesis tokens, recall = mean over reference tokens, F1 = 2PR/(P+R). A pair of which one
    side has no vectors gets NULL. A token whose vector is NULL or has a NULL component matches nothing
    and does not count.

    Both sides are dealt into blocks of about ``block`` tokens. A task forms the similarity
    matrix of one block pair (numpy) and returns each token's best value there; the maxima over
    blocks and the means are Spark aggregates, so no task holds a whole long text.
    """
    import numpy as np
    import pandas as pd

    sizes = token_vectors.groupBy("text_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    tokens = token_vectors.where(whole).join(sizes, "text_id").select(
        "text_id", "pos", "vec", F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int").alias("own"))
    keyed = pairs.select("ref_id", "hyp_id").distinct()
    both = (keyed.join(sizes.select(F.col("text_id").alias("ref_id"), F.col("blocks").alias("ref_blocks")), "ref_id")
            .join(sizes.select(F.col("text_id").alias("hyp_id"), F.col("blocks").alias("hyp_blocks")), "hyp_id"))

    def side(name: str, other: str) -> DataFrame:
        rows = both.join(tokens.withColumnRenamed("text_id", f"{name}_id"), f"{name}_id")
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        own, far = ("own", "other") if name == "ref" else ("other", "own")
        # the two sides are cogrouped by columns of different names, as both stem from ``pairs``
        return rows.select(F.col("ref_id").alias(f"{name}_r"), F.col("hyp_id").alias(f"{name}_h"),
                           F.col(own).alias(f"{name}_rb"), F.col(far).alias(f"{name}_hb"), "pos", "vec")

    def match(ref: pd.DataFrame, hyp: pd.DataFrame) -> pd.DataFrame:
        if not len(ref) or not len(hyp):
            return pd.DataFrame({"ref_id": [], "hyp_id": [], "side": [], "pos": [], "best": []})
        r, h = (np.vstack(x["vec"].to_numpy()).astype("float64") for x in (ref, hyp))
        r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300)
        h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-300)
        sim = r @ h.T
        parts = [pd.DataFrame({"ref_id": x[f"{name}_r"], "hyp_id": x[f"{name}_h"], "side": axis, "pos": x["pos"],
                               "best": sim.max(axis=axis)}) for name, x, axis in (("ref", ref, 1), ("hyp", hyp, 0))]
        return pd.concat(parts)

    def grouped(name: str, other: str):
        return side(name, other).groupBy(*[f"{name}_{k}" for k in ("r", "h", "rb", "hb")])

    kinds = dict(token_vectors.dtypes)
    best = grouped("ref", "hyp").cogroup(grouped("hyp", "ref")).applyInPandas(
        match, f"ref_id {kinds['text_id']}, hyp_id {kinds['text_id']}, side int, pos {kinds['pos']}, best double")
    best = best.groupBy("ref_id", "hyp_id", "side", "pos").agg(F.max("best").alias("best"))
    means = best.groupBy("ref_id", "hyp_id").agg(
        F.avg(F.when(F.col("side") == 0, F.col("best"))).alias("precision"),
        F.avg(F.when(F.col("side") == 1, F.col("best"))).alias("recall"))
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total != 0, 2 * F.col("precision") * F.col("recall") / total).when(total == 0, F.lit(0.0))
    return pairs.join(means.withColumn("f1", f1), ["ref_id", "hyp_id"], "left").select(
        *pairs.columns, "precision", "recall", "f1")


def mean_match_by_stage(matched: DataFrame) -> DataFrame:
    """Mean greedy-match F1 per stage, labelled BERTSCORE-F1."""
    return (matched.groupBy("stage").agg(F.avg("f1").alias("score"))
            .select("stage", F.lit("BERTSCORE-F1").alias("metric"), "score"))

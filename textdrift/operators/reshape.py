"""Reshaping: chains, dedup, melt, seeded samples, balancing, splits, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textdrift.constants import LATER_STAGES, ORIGINAL, STAGES
from textdrift.functions import text as tx
from textdrift.operators.derive import with_version_columns

DOC_KEYS = ["dataset", "key", "source"]
CHAIN_KEYS = DOC_KEYS + ["paraphraser"]

# the md5 order is cut into 16^4 = 65,536 buckets by its first four hex digits
_BUCKET_DIGITS = 4


def build_chains(versions: DataFrame, values=(), order_col: str = "seq") -> DataFrame:
    """Long version table -> one row per (dataset, key, source, paraphraser).

    Columns: dataset, key, source, paraphraser, family, T0, T1, T2, T3 (+ ``<value>_<stage>`` for
    each extra column in ``values``). Per stage the first row wins (lowest ``order_col``, then
    lowest text). A document without any rewrite gives no chain; missing stages stay NULL; rows
    without a version name belong to no chain; NULL keys group together.

    Plan: the first aggregate, keyed by document and rewriter, holds one ``min(struct)`` slot per
    stage, so that duplicate versions collapse before any exchange; the second gathers a
    document's rewriters (one row each) and hands the original to all of them. Any rewriter name
    is taken as it comes. On input that is partitioned by document neither plans an exchange.
    """
    lv = versions if "stage" in versions.columns else with_version_columns(versions)
    values = list(values)
    order = F.col(order_col) if order_col in lv.columns else F.col("version_name")
    slot = F.struct(order.alias("_o"), F.col("text").alias("text"), *[F.col(v).alias(v) for v in values])
    original = F.col("paraphraser") == ORIGINAL
    relevant = lv.where(F.col("stage").isNotNull() & (original == (F.col("stage") == "T0")))
    slots = relevant.groupBy(*DOC_KEYS, "paraphraser").agg(
        *[F.min(F.when(F.col("stage") == st, slot)).alias(f"_{st}") for st in STAGES])
    per_doc = slots.groupBy(*DOC_KEYS).agg(
        F.max(F.when(original, F.col("_T0"))).alias("_T0"),
        F.collect_list(F.when(~original, F.struct("paraphraser", *[f"_{st}" for st in LATER_STAGES]))).alias("_c"))
    rows = per_doc.select(*DOC_KEYS, "_T0", F.inline("_c"))
    out = [*DOC_KEYS, "paraphraser", tx.family_of("paraphraser").alias("family")]
    out += [F.col(f"_{st}.text").alias(st) for st in STAGES]
    out += [F.col(f"_{st}.{v}").alias(f"{v}_{st}") for v in values for st in STAGES]
    return rows.select(*out)


def chain_stages(versions: DataFrame) -> DataFrame:
    """R1 for queries that only ask which stages a chain has: the same chains, with an empty text where
    ``build_chains`` has a text. Of equal places a NULL text comes first in both, so no text is sorted
    or shuffled."""
    return build_chains(versions.withColumn("text", F.when(F.col("text").isNotNull(), F.lit(""))))


def chains_with(versions: DataFrame, stages) -> DataFrame:
    """R1 for queries that read the texts of ``stages`` alone: the same chains, whose other texts are NULL and are
    neither made nor sorted."""
    lv = versions if "stage" in versions.columns else with_version_columns(versions)
    return build_chains(lv.withColumn("text", F.when(F.col("stage").isin(*stages), F.col("text"))))


def dedup_first(df: DataFrame, keys, order_cols) -> DataFrame:
    """R2: keep the first row per key by ``order_cols`` (then by all other columns).

    Deterministic for any partitioning, unlike ``dropDuplicates``; the partial aggregate keeps
    one row per key and map task before the exchange.
    """
    keys = list(keys)
    order_cols = list(order_cols)
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    best = F.min(F.struct(*[F.col(c) for c in order_cols + rest])).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c)
                                                       for c in order_cols + rest]) \
        .select(*df.columns)


def union_tagged(frames: dict) -> DataFrame:
    """Stack frames (dataset name -> DataFrame) with a ``dataset`` column."""
    tagged = [df.withColumn("dataset", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def melt_chains(chains: DataFrame, ids=None, stages=STAGES, value_name: str = "text",
                keep_blank: bool = False) -> DataFrame:
    """Wide chains -> long (ids..., stage, text), skipping null (and blank) texts."""
    ids = list(ids) if ids is not None else [c for c in chains.columns if c not in STAGES]
    long = chains.unpivot(ids, list(stages), "stage", value_name)
    cond = F.col(value_name).isNotNull()
    if not keep_blank:
        cond = cond & ~tx.is_blank(value_name)
    return long.where(cond)


def rank_key(seed, id_cols) -> Column:
    """Repeatable pseudo-random order: md5 of ``seed:id...`` (equal in Spark and DuckDB)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[
        F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in id_cols]))


def sample_n(df: DataFrame, n: int, id_cols, by=None, seed: int = 42) -> DataFrame:
    """Exact seeded sample of min(n, size) rows, overall or per group of ``by``.

    The window's row-number filter becomes a WindowGroupLimit that keeps at most n rows per
    group and map task before the exchange, so a huge group never reaches one task whole.
    """
    rk = rank_key(seed, id_cols)
    if not by:
        return df.withColumn("_rk", rk).orderBy("_rk", *id_cols).limit(n).drop("_rk")
    w = Window.partitionBy(*by).orderBy("_rk", *id_cols)
    return (df.withColumn("_rk", rk).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= n).drop("_rk", "_rn"))


def flag_head_per_group(df: DataFrame, group_cols, order_col: str, id_cols, k_of) -> DataFrame:
    """Flag ``_head`` = row is among the k smallest of its group by (order_col, ids).

    ``order_col`` is an md5 hex string; ``k_of(total, min_total)`` gives k from the group size and
    the smallest group size. Exact and skew-proof: rows are counted per (group, 4-hex-digit
    bucket) (at most groups x 65,536 rows), buckets wholly inside the cut are flagged in bulk,
    and only the one crossing bucket per group (about size/65,536 rows) is ranked by a window.
    NULL groups are groups like any other. Spark picks the join with the small count table from
    its size at run time.
    """
    group_cols = list(group_cols)
    b = F.substring(F.col(order_col), 1, _BUCKET_DIGITS)
    tagged = df.withColumn("_b", b)
    counts = tagged.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wg = Window.partitionBy(*group_cols)
    run = wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = (counts.withColumn("_after", F.sum("_n").over(run))
           .withColumn("_total", F.sum("_n").over(wg)))
    cum = cum.withColumn("_mintotal", F.min("_total").over(Window.partitionBy()))
    cum = cum.withColumn("_k", k_of(F.col("_total"), F.col("_mintotal")).cast("long"))
    cuts = cum.select(*group_cols, "_b", (F.col("_after") - F.col("_n")).alias("_before"),
                      "_after", "_k")
    cuts = cuts.withColumnsRenamed({c: f"_cut_{c}" for c in [*group_cols, "_b"]})
    same = [F.col(c).eqNullSafe(F.col(f"_cut_{c}")) for c in [*group_cols, "_b"]]
    joined = tagged.join(cuts, same).drop(*[f"_cut_{c}" for c in [*group_cols, "_b"]])
    partial = (F.col("_before") < F.col("_k")) & (F.col("_after") > F.col("_k"))
    whole = joined.where(~partial).withColumn("_head", F.col("_after") <= F.col("_k"))
    w = Window.partitionBy(*group_cols, "_b").orderBy(order_col, *id_cols)
    crossing = (joined.where(partial)
                .withColumn("_head", F.row_number().over(w) <= F.col("_k") - F.col("_before")))
    return whole.unionByName(crossing).drop("_b", "_before", "_after", "_k")


def head_condition(df: DataFrame, group_col: str, id_cols, k_of, seed: int = 42) -> Column:
    """A condition that holds for the k smallest rows of each group by the seeded md5 order, as in
    ``flag_head_per_group``, and tells them by their group and ids alone. It may be asked of any table with these
    columns, so that no text is joined or shuffled to find its head. The ids of ``df`` must not repeat; one row for
    each group is collected."""
    keys = df.select(group_col, *id_cols).withColumn("_rk", rank_key(seed, id_cols))
    head = flag_head_per_group(keys, [group_col], "_rk", id_cols, k_of).where("_head")
    last = head.groupBy(group_col).agg(F.max(F.struct("_rk", *id_cols)).alias("_last")).collect()
    own, holds = F.struct(rank_key(seed, id_cols).alias("_rk"), *id_cols), F.lit(False)
    kinds = dict(keys.dtypes)
    for r in last:
        cut = F.struct(*[F.lit(r["_last"][c]).cast(kinds[c]).alias(c) for c in ["_rk", *id_cols]])
        holds = holds | (F.col(group_col).eqNullSafe(F.lit(r[group_col])) & (own <= cut))
    return holds


def balance_classes(df: DataFrame, label_col: str, id_cols, seed: int = 42) -> DataFrame:
    """Down-sample every class to the size of the smallest, by the seeded md5 order."""
    rk = df.withColumn("_rk", rank_key(seed, id_cols))
    flagged = flag_head_per_group(rk, [label_col], "_rk", id_cols, lambda total, mn: mn)
    return flagged.where("_head").drop("_head", "_rk")


def stratified_split(df: DataFrame, label_col: str, id_cols, test_frac: float = 0.25,
                     seed: int = 42) -> DataFrame:
    """Add ``split`` = test for the first ceil(test_frac * class size) rows of each class."""
    rk = df.withColumn("_rk", rank_key(seed, id_cols))
    flagged = flag_head_per_group(rk, [label_col], "_rk", id_cols,
                                  lambda total, mn: F.ceil(total * F.lit(test_frac)))
    return (flagged.withColumn("split", F.when(F.col("_head"), "test").otherwise("train"))
            .drop("_head", "_rk"))


def seeded_order(df: DataFrame, id_cols, seed: int = 42) -> DataFrame:
    """Shuffle all rows repeatably (a range-partitioned sort on the md5 key)."""
    return df.withColumn("_rk", rank_key(seed, id_cols)).orderBy("_rk", *id_cols).drop("_rk")


def lookup_chain(chains: DataFrame, dataset: str, key: str, source: str,
                 paraphraser: str) -> DataFrame:
    """One chain's four stages with word counts; absent stages give NULL text, count 0."""
    hit = chains.where((F.col("dataset") == dataset) & (F.col("key") == key)
                       & (F.col("source") == source) & (F.col("paraphraser") == paraphraser))
    long = hit.unpivot([], STAGES, "stage", "text").groupBy("stage").agg(F.min("text").alias("text"))
    stages = chains.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    return (stages.join(long, "stage", "left")
            .select("stage", "text",
                    F.when(F.col("text").isNull(), F.lit(0).cast("long"))
                    .otherwise(tx.word_count("text")).alias("word_count"),
                    F.col("text").isNotNull().alias("found")))


def nth_document(chains: DataFrame, i: int, order_cols=("key", "source")) -> DataFrame:
    """The i-th chain (1-based, by key) of every (dataset, family) group."""
    w = Window.partitionBy("dataset", "family").orderBy(*order_cols)
    return (chains.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == i).drop("_rn"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)

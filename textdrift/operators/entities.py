"""Entities: sets per text, retention of T0's entities in later versions, summaries.

Mentions come from patterns (URLs, e-mail addresses, numbers, runs of capitalised words); any
tagger's mention table can take their place (``mentions=``); its sets are gathered for each row of the
LONG version table and carried into chains by the same plan as the texts (R1). Those of the patterns are
found in the texts of the chains, once for an original that consecutive chains share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textdrift.constants import INTENSITY_VARIANTS, LATER_STAGES, STAGES
from textdrift.functions import text as tx
from textdrift.functions import words as wd
from textdrift.operators.reshape import CHAIN_KEYS, build_chains

# ---------------------------------------------------------------------------------------------
# Mention patterns, tried left to right
# ---------------------------------------------------------------------------------------------
URL_RE = rf"https?://[^{tx.WS_CHARS}]+"
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+"
NUMBER_RE = r"\p{N}+(?:[.,]\p{N}+)*"
NAME_RE = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"
MENTION_RE = "|".join([URL_RE, EMAIL_RE, NUMBER_RE, NAME_RE])

RETENTION_METRICS = ["jaccard", "recall", "precision", "n_ref", "n_hyp", "n_shared"]


def mention_label(m: Column) -> Column:
    return (F.when(m.rlike("^https?://"), "URL")
            .when(m.contains("@"), "EMAIL")
            .when(m.rlike(r"^\p{N}"), "NUMBER")
            .otherwise("NAME"))


def _cut(text, max_chars: int | None) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return t if max_chars is None else F.substring(t, 1, int(max_chars))


def entity_set(text, max_chars: int | None = None) -> Column:
    """Distinct lower-cased mentions of a text (MENTION_RE, found in Arrow batches; none begins or ends
    with a space); blank or NULL text -> empty set."""
    return wd.mentions(_cut(text, max_chars))


def entity_set_typed(text, max_chars: int | None = None) -> Column:
    """Distinct (text, label) structs."""
    return wd.typed_mentions(_cut(text, max_chars))


def entity_sets(versions: DataFrame, text_col: str = "text", out: str = "ents",
                max_chars: int | None = None, mentions: DataFrame | None = None,
                id_cols=("dataset", "key", "source", "version_name", "seq")) -> DataFrame:
    """``versions`` with the entity set of each row.

    ``mentions`` (``id_cols``, mention) is any tagger's table; its mentions, lower-cased and
    trimmed, then take the place of the patterns. Rows without mentions have an empty set.
    """
    if mentions is None:
        return versions.withColumn(out, entity_set(text_col, max_chars))
    found = mentions.groupBy(*[F.col(c).alias(f"_own_{c}") for c in id_cols]).agg(
        F.collect_set(F.lower(F.trim("mention"))).alias(out))
    same = [versions[c].eqNullSafe(F.col(f"_own_{c}")) for c in id_cols]
    return versions.join(found, same, "left").select(
        versions["*"], F.coalesce(out, F.array().cast("array<string>")).alias(out))


def entity_sets_typed(versions: DataFrame, mentions: DataFrame, out: str = "ents",
                      id_cols=("dataset", "key", "source", "version_name", "seq")) -> DataFrame:
    """E2 from a mention table (``id_cols``, mention, label): ``versions`` with the distinct
    (text, label) structs of each row, sorted; rows without mentions have an empty set."""
    typed = F.struct(F.lower(F.trim("mention")).alias("text"), F.col("label"))
    found = mentions.groupBy(*[F.col(c).alias(f"_own_{c}") for c in id_cols]).agg(
        F.sort_array(F.collect_set(typed)).alias(out))
    same = [versions[c].eqNullSafe(F.col(f"_own_{c}")) for c in id_cols]
    return versions.join(found, same, "left").select(
        versions["*"], F.coalesce(out, F.array().cast("array<struct<text:string,label:string>>")).alias(out))


def retention(ref: Column, hyp: Column) -> Column:
    """struct(jaccard, recall, precision, n_ref, n_hyp, n_shared) of two entity sets.

    Both empty -> 1, 1, 1; empty reference -> 0, NULL, 0; empty hypothesis -> 0, 0, NULL.
    """
    n_ref = F.size(ref).cast("long")
    n_hyp = F.size(hyp).cast("long")
    shared = F.size(F.array_intersect(ref, hyp)).cast("long")
    union = F.size(F.array_union(ref, hyp)).cast("long")
    null = F.lit(None).cast("double")
    both = (n_ref == 0) & (n_hyp == 0)
    jac = F.when(both, 1.0).when((n_ref == 0) | (n_hyp == 0), 0.0).otherwise(shared / union)
    rec = F.when(both, 1.0).when(n_ref == 0, null).when(n_hyp == 0, 0.0).otherwise(shared / n_ref)
    pre = F.when(both, 1.0).when(n_ref == 0, 0.0).when(n_hyp == 0, null).otherwise(shared / n_hyp)
    sh = F.when((n_ref == 0) | (n_hyp == 0), F.lit(0).cast("long")).otherwise(shared)
    return F.struct(jac.alias("jaccard"), rec.alias("recall"), pre.alias("precision"),
                    n_ref.alias("n_ref"), n_hyp.alias("n_hyp"), sh.alias("n_shared"))


def entities_for_chains(versions: DataFrame, max_chars: int | None = None,
                        mentions: DataFrame | None = None) -> DataFrame:
    """Chains with ``ner_T0..ner_T3`` (missing stage -> empty set, like an empty text)."""
    if mentions is None:
        # a set depends on its text alone: found after R1, so that no set is sorted with the texts and the
        # partitioning by document holds for R1; the chains of a document lie together and share T0's set
        ch = build_chains(versions)
        sets = [entity_set(s, max_chars) for s in STAGES]
    else:
        ch = build_chains(entity_sets(versions, mentions=mentions), values=["ents"])
        sets = [F.coalesce(F.col(f"ents_{s}"), F.array().cast("array<string>")) for s in STAGES]
    return ch.select(*CHAIN_KEYS, "family", "T0", "T1", "T2", "T3",
                     *[e.alias(f"ner_{s}") for s, e in zip(STAGES, sets)])


def retention_long(ner_chains: DataFrame) -> DataFrame:
    """E5 (long form): (chain keys, family, stage, 6 metrics) for T1..T3 against T0."""
    per_stage = F.array(*[F.struct(F.lit(s).alias("stage"),
                                   retention(F.col("ner_T0"), F.col(f"ner_{s}")).alias("m"))
                          for s in LATER_STAGES])
    x = ner_chains.select(*CHAIN_KEYS, "family", F.inline(per_stage))
    return x.select(*CHAIN_KEYS, "family", "stage", *[F.col(f"m.{c}").alias(c)
                                                      for c in RETENTION_METRICS])


def retention_for_chains(ner_chains: DataFrame) -> DataFrame:
    """E5: wide ``<metric>_<stage>`` columns, as in the reference's chain table."""
    cols = []
    for s in LATER_STAGES:
        r = retention(F.col("ner_T0"), F.col(f"ner_{s}"))
        cols += [r[c].alias(f"{c}_{s}") for c in RETENTION_METRICS]
    return ner_chains.select(*CHAIN_KEYS, "family", *cols)


def retention_summary(ret: DataFrame) -> DataFrame:
    """By stage: mean jaccard, recall, precision (NULLs skipped), mean T0 and Tn entities."""
    return ret.groupBy("stage").agg(
        F.avg("jaccard").alias("jaccard"), F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"), F.avg("n_ref").alias("mean_t0_entities"),
        F.avg("n_hyp").alias("mean_tn_entities"))


def retention_by_domain(ret: DataFrame) -> DataFrame:
    """By dataset x stage; 'mean T0 entities' is the T0 set size (equal for every stage)."""
    return ret.groupBy("dataset", "stage").agg(
        F.avg("jaccard").alias("jaccard"), F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"), F.avg("n_ref").alias("mean_t0_entities"))


def retention_macro(by_domain: DataFrame) -> DataFrame:
    """Unweighted mean of the dataset means per stage."""
    return by_domain.groupBy("stage").agg(
        F.avg("jaccard").alias("jaccard"), F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"))


def capitalised(c) -> Column:
    """Python's str.capitalize: first character upper, the rest lower."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def retention_by_family(ret: DataFrame, families=None) -> DataFrame:
    """Mean jaccard/recall/precision and chain count by family x stage (name capitalised)."""
    src = ret.where(F.col("family").isin(*families)) if families else \
        ret.where(~F.col("family").isin("none", "unknown"))
    return src.groupBy(capitalised("family").alias("family"), "stage").agg(
        F.avg("jaccard").alias("jaccard"), F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"), F.count(F.lit(1)).alias("n"))


def drop_vs_hallucinate(ret: DataFrame, min_n: int = 10) -> DataFrame:
    """Mean recall/precision at T3 by family and by paraphraser (paraphrasers with n >= min_n)."""
    t3 = ret.where(F.col("stage") == "T3")
    sets = t3.groupingSets([["family"], ["paraphraser"]], "family", "paraphraser").agg(
        F.avg("recall").alias("recall"), F.avg("precision").alias("precision"),
        F.count(F.lit(1)).alias("n"), F.grouping("family").alias("_para"))
    para = F.col("_para") == 1
    return sets.where(~para | (F.col("n") >= min_n)).select(
        F.when(para, "paraphraser").otherwise("family").alias("level"),
        F.when(para, F.col("paraphraser")).otherwise(F.col("family")).alias("name"), "recall", "precision", "n")


def t3_domain_ranking(by_domain: DataFrame) -> DataFrame:
    """Dataset rows at T3, by jaccard descending."""
    return (by_domain.where(F.col("stage") == "T3")
            .select("dataset", "jaccard", "recall", "precision")
            .orderBy(F.desc("jaccard"), "dataset"))


def intensity_comparison(ret: DataFrame) -> DataFrame:
    """Low vs high variant of pegasus and dipper: means and n by variant x stage.

    The 4-row variant table is a literal of fixed size, joined by broadcast.
    """
    spark = ret.sparkSession
    variants = spark.createDataFrame(
        [(fam.capitalize(), para, level) for fam, para, level in INTENSITY_VARIANTS],
        "family_label string, paraphraser string, intensity string")
    j = ret.join(F.broadcast(variants), "paraphraser")
    return j.groupBy("family_label", "paraphraser", "intensity", "stage").agg(
        F.avg("jaccard").alias("jaccard"), F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"), F.count(F.lit(1)).alias("n")) \
        .withColumnRenamed("family_label", "family").withColumnRenamed("paraphraser", "variant")


def worst_families(by_family: DataFrame) -> DataFrame:
    """Recall and precision at T3 by family, lowest recall first."""
    return (by_family.where(F.col("stage") == "T3").select("family", "recall", "precision")
            .orderBy("recall", "family"))

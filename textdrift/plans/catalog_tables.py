"""Queries over stored bucketed tables, the gazetteer, cluster moments and mergeable sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textdrift.constants import LATER_STAGES
from textdrift.operators import clusters as cl
from textdrift.operators import counts as co
from textdrift.operators import derive as de
from textdrift.operators import entities as en
from textdrift.operators import gazetteer as gz
from textdrift.operators import reshape as rs
from textdrift.plans import sql as S
from textdrift.plans.catalog import CHS, ORACLE, VK, VKS, chains, register, rnd
from textdrift.plans import catalog_more as more
from textdrift.session import ensure_checkpoint_dir
from textdrift.sources import fixtures as fx
from textdrift.sources import io

BUCKETS = 64


def stored_table(spark, df, name: str, sort=(), dealt: bool = False):
    """``df`` bucketed by document under the checkpoint folder, as a table of its own."""
    table = f"{name}_{uuid.uuid4().hex}"
    return io.store_by_document(df, table, f"{ensure_checkpoint_dir(spark)}/{table}", BUCKETS, sort, dealt)


def _stored_versions(spark, sf):
    """The version table: its documents are dealt to the buckets before they become versions, which are not shuffled."""
    return stored_table(spark, de.with_version_columns(fx.versions(spark, sf, parts=BUCKETS)), "versions", dealt=True)


# ---------------------------------------------------------------------------------------------
# Tables bucketed by document
# ---------------------------------------------------------------------------------------------

@register("r1_stored_versions", ORACLE["r1_build_chains"])
def r1_stored_versions(spark, sf):
    """Chains of a stored version table: no exchange after the landing."""
    return rs.build_chains(_stored_versions(spark, sf))


@register("s3_stored_chains", S.F1_CHAINS + f"""
SELECT dataset, key, source, count(*) AS n_chains, count(T2) AS n_t2 FROM chains GROUP BY dataset, key, source""")
def s3_stored_chains(spark, sf):
    """Rewriters and second rewrites of each document, from a stored chain table."""
    stored = stored_table(spark, chains(spark, sf), "chains", ("paraphraser",))
    return stored.groupBy("dataset", "key", "source").agg(F.count(F.lit(1)).alias("n_chains"), F.count("T2").alias("n_t2"))


@register("e5_stored_versions", more._e5_sql())
def e5_stored_versions(spark, sf):
    """Entity retention of a stored version table: sets, chains and metrics without an exchange."""
    ner = en.entities_for_chains(_stored_versions(spark, sf))
    w = en.retention_for_chains(ner)
    doubles = [f"{m}_{s}" for m in more.DBL for s in LATER_STAGES]
    return more._rnd_all(w.select(*CHS.split(", "), "family", *[c for c in w.columns if c[-2:] in LATER_STAGES]), doubles)


# ---------------------------------------------------------------------------------------------
# gazetteer
# ---------------------------------------------------------------------------------------------

def _gazetteer_sql() -> str:
    steps = ", ".join(f"({n})" for n in fx.F5_WORDS)
    ahead = "OVER (PARTITION BY " + VKS + " ORDER BY i)"
    return S.with_(
        S.versions_cte(),
        f"""gaz AS (SELECT DISTINCT array_to_string(list_slice(t, 1, n), ' ') AS p, label FROM (
  SELECT {S.rouge_tokens('text')} AS t, {S.case_mod('item_id', 3, fx.F5_CLASSES)} AS label FROM benchmark) b,
  (VALUES {steps}) l(n) WHERE n <= len(t))""",
        f"""tok AS (SELECT {VKS}, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (
  SELECT {VKS}, {S.rouge_tokens(S.guard('text'))} AS t FROM versions) x)""",
        f"nxt AS (SELECT *, lead(w, 1) {ahead} AS w2, lead(w, 2) {ahead} AS w3 FROM tok)",
        f"""spans AS (SELECT {VKS}, i, i + 1 AS e, w AS p FROM nxt
  UNION ALL SELECT {VKS}, i, i + 2, w || ' ' || w2 FROM nxt WHERE w2 IS NOT NULL
  UNION ALL SELECT {VKS}, i, i + 3, w || ' ' || w2 || ' ' || w3 FROM nxt WHERE w3 IS NOT NULL)""",
        "hits AS (SELECT * FROM spans WHERE p IN (SELECT p FROM gaz))",
        f"""kept AS (SELECT h.* FROM (SELECT *, max(e) OVER (PARTITION BY {VKS} ORDER BY i, e DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM hits) h WHERE reached IS NULL OR reached < e)""")


def _gazetteer_mentions(spark, sf):
    v = fx.versions(spark, sf, in_batches=True)
    return v, gz.gazetteer_mentions(v, fx.gazetteer(spark, sf), VK, each_once=True)


@register("e1_gazetteer", _gazetteer_sql() + f"""
SELECT {VKS}, coalesce(f.entities, '') AS entities FROM versions LEFT JOIN (
  SELECT {VKS}, string_agg(DISTINCT p, '|' ORDER BY p) AS entities FROM kept GROUP BY {VKS}) f USING ({VKS})""")
def e1_gazetteer(spark, sf):
    """Entity sets from the longest gazetteer phrases of each version."""
    v, found = _gazetteer_mentions(spark, sf)
    return en.entity_sets(v, mentions=found).select(*VK, F.array_join(F.array_sort("ents"), "|").alias("entities"))


@register("e2_gazetteer_typed", _gazetteer_sql() + f"""
SELECT {VKS}, coalesce(f.entities, '') AS entities FROM versions LEFT JOIN (
  SELECT {VKS}, string_agg(DISTINCT p || '#' || label, '|' ORDER BY p || '#' || label) AS entities
  FROM kept JOIN gaz USING (p) GROUP BY {VKS}) f USING ({VKS})""")
def e2_gazetteer_typed(spark, sf):
    """The same with classes: a phrase of several classes is one entity of each."""
    v, found = _gazetteer_mentions(spark, sf)
    pairs = F.transform("ents", lambda x: F.concat(x["text"], F.lit("#"), x["label"]))
    return en.entity_sets_typed(v, found).select(*VK, F.array_join(F.array_sort(pairs), "|").alias("entities"))


# ---------------------------------------------------------------------------------------------
# Silhouettes from cluster moments; C5: sketches
# ---------------------------------------------------------------------------------------------

@register("l13_silhouette_labels", f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL),
sums AS (SELECT label, list(s ORDER BY i) AS s FROM (
  SELECT label, i, sum(xi) AS s FROM (SELECT label, unnest(x) AS xi, generate_subscripts(x, 1) AS i FROM v) u
  GROUP BY label, i) g GROUP BY label),
sizes AS (SELECT label, count(*) AS n, sum(list_dot_product(x, x)) AS q FROM v GROUP BY label),
far AS (SELECT v.vec_id, v.label, m.label AS other, n,
  greatest(0, list_dot_product(x, x) + q / n - 2 * list_dot_product(x, s) / n) AS d
  FROM v, (SELECT * FROM sums JOIN sizes USING (label)) m),
ab AS (SELECT vec_id, label, any_value(n) FILTER (WHERE other = label) AS n,
  any_value(CASE WHEN n > 1 THEN d * n / (n - 1) END) FILTER (WHERE other = label) AS a, min(d) FILTER (WHERE other <> label) AS b
  FROM far GROUP BY vec_id, label),
sil AS (SELECT label, CASE WHEN b IS NULL THEN NULL WHEN n = 1 OR a = b THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)
SELECT label, count(*) AS n_rows, {S.rnd('avg(s)')} AS silhouette FROM sil GROUP BY label""")
def l13_silhouette_labels(spark, sf):
    """Mean silhouette of every label of the embeddings."""
    emb = fx.read_table(spark, sf, "embeddings")
    return cl.silhouette_by_cluster(emb, "label", "embedding").select("label", "n_rows", rnd("silhouette").alias("silhouette"))


@register("c5_corpus_stats_sketched")
def c5_corpus_stats_sketched(spark, sf):
    """C5 with distinct counts by mergeable sketches."""
    return co.corpus_stats_sketched(chains(spark, sf))

"""Registered queries: one per operator of the inventory, each with its DuckDB oracle SQL.

Every query reads the driver tables (or fixtures Spark derives from them) in full and keeps
whole texts. Doubles are rounded to 9 places on both sides (rounding only affects the check,
not the operators). Queries whose SQL would be too slow on whole tables (LCS) or that train
models have no SQL entry; they are checked by tests against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textdrift.constants import LATER_STAGES, STAGES, WORKING_DATASETS
from textdrift.functions import text as tx
from textdrift.operators import counts as co
from textdrift.operators import derive as de
from textdrift.operators import reshape as rs
from textdrift.operators import similarity as sm
from textdrift.plans import sql as S
from textdrift.session import stored
from textdrift.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# doubles of the check are rounded to 9 places in both engines: far below any reported
# precision, far above float noise, and (unlike 6 places) no mean of 4-place features lands on
# an exact rounding boundary
CHECK_PLACES = 9


def rnd(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, CHECK_PLACES)


# ---------------------------------------------------------------------------------------------
# shared Spark inputs
# ---------------------------------------------------------------------------------------------

def long_versions(spark, sf) -> DataFrame:
    return de.with_version_columns(fx.versions(spark, sf))


def chains(spark, sf) -> DataFrame:
    return rs.build_chains(long_versions(spark, sf))


def turn_chains(spark, sf) -> DataFrame:
    return rs.build_chains(de.with_version_columns(fx.turn_versions(spark, sf)))


CH = rs.CHAIN_KEYS
CHS = ", ".join(CH)
VK = ["dataset", "key", "source", "version_name", "seq"]
VKS = ", ".join(VK)

# ---------------------------------------------------------------------------------------------
# S: sources
# ---------------------------------------------------------------------------------------------


@register("s1_versions", S.with_(S.versions_cte(), S.long_cte()) + """
SELECT dataset, source, key, version_name, seq, stage, paraphraser, family, text FROM lv""")
def s1_versions(spark, sf):
    return long_versions(spark, sf).select("dataset", "source", "key", "version_name", "seq",
                                           "stage", "paraphraser", "family", "text")


@register("s2_working_subset", S.with_(S.versions_cte(), S.long_cte()) + f"""
SELECT dataset, stage, count(*) AS n FROM lv
WHERE dataset IN ({', '.join(S.q(d) for d in WORKING_DATASETS)}) GROUP BY dataset, stage""")
def s2_working_subset(spark, sf):
    lv = long_versions(spark, sf).where(F.col("dataset").isin(*WORKING_DATASETS))
    return lv.groupBy("dataset", "stage").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------------------------
# P: projections
# ---------------------------------------------------------------------------------------------

_P13_SQL = S.with_(S.versions_cte("v1"), S.turn_versions_cte("v2"),
                   "versions AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2)", S.long_cte()) + """
SELECT version_name, stage, paraphraser, family, count(*) AS n FROM lv
GROUP BY version_name, stage, paraphraser, family"""


@register("p1_p3_version_map", _P13_SQL)
def p1_p3_version_map(spark, sf):
    v = fx.versions(spark, sf).unionByName(fx.turn_versions(spark, sf))
    return de.with_version_columns(v).groupBy("version_name", "stage", "paraphraser", "family") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("p4_source_group", S.with_(S.versions_cte(), S.long_cte()) + """
SELECT CASE WHEN source = 'Human' THEN 'Human' ELSE 'AI' END AS grp, count(*) AS n FROM lv
GROUP BY grp""")
def p4_source_group(spark, sf):
    return long_versions(spark, sf).groupBy(tx.source_group("source").alias("grp")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("p5_p7_preprocess", S.with_(S.versions_cte()) + f"""
SELECT {VKS}, cleaned_text, {S.remove_stopwords('cleaned_text')} AS no_stop_text
FROM (SELECT *, {S.clean_text('text')} AS cleaned_text FROM versions)""")
def p5_p7_preprocess(spark, sf):
    return de.preprocess(fx.versions(spark, sf, in_batches=True)).select(*VK, "cleaned_text", "no_stop_text")


@register("p8_text_stats", S.with_(S.versions_cte()) + f"""
SELECT {VKS}, {S.word_count('text')} AS word_count, {S.word_count('cleaned_text')} AS cleaned_word_count,
  {S.word_count('no_stop_text')} AS no_stop_word_count,
  len(list_distinct({S.tokens('cleaned_text', tx.ROUGE_TOKEN_RE)})) AS unique_words
FROM (SELECT *, {S.remove_stopwords('cleaned_text')} AS no_stop_text
      FROM (SELECT *, {S.clean_text('text')} AS cleaned_text FROM versions))""")
def p8_text_stats(spark, sf):
    return de.text_stats(de.preprocess(fx.versions(spark, sf, in_batches=True)), keep=VK)


@register("p9_guard_text_turns", S.with_(S.turn_versions_cte()) + f"""
SELECT key, source, version_name, seq, CAST(length({S.guard('text')}) AS BIGINT) AS guarded_len,
       {S.guard('text')} = '' AS is_blank FROM versions""")
def p9_guard_text_turns(spark, sf):
    g = tx.guard_text("text")
    return fx.turn_versions(spark, sf).select("key", "source", "version_name", "seq",
                                              F.length(g).cast("long").alias("guarded_len"),
                                              (g == "").alias("is_blank"))


@register("p10_valid_pairs", S.F1_CHAINS + """
SELECT dataset, stage, count(*) AS n_valid FROM (
  SELECT dataset, 'T1' AS stage FROM chains WHERE T0 IS NOT NULL AND T1 IS NOT NULL
  UNION ALL SELECT dataset, 'T2' FROM chains WHERE T0 IS NOT NULL AND T2 IS NOT NULL
  UNION ALL SELECT dataset, 'T3' FROM chains WHERE T0 IS NOT NULL AND T3 IS NOT NULL)
GROUP BY dataset, stage""")
def p10_valid_pairs(spark, sf):
    ch = chains(spark, sf)
    parts = [de.valid_pairs(ch, s).select("dataset", F.lit(s).alias("stage")) for s in LATER_STAGES]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("dataset", "stage").agg(F.count(F.lit(1)).alias("n_valid"))


@register("p11_filter_chains", S.F1_CHAINS + """
SELECT dataset, family, paraphraser, count(*) AS n FROM chains
WHERE dataset IN ('wp', 'xsum') AND family IN ('dipper', 'palm')
GROUP BY dataset, family, paraphraser""")
def p11_filter_chains(spark, sf):
    f = de.filter_chains(chains(spark, sf), datasets=["wp", "xsum"], families=["dipper", "palm"])
    return f.groupBy("dataset", "family", "paraphraser").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------------------------
# R: reshaping
# ---------------------------------------------------------------------------------------------


@register("r1_build_chains", S.F1_CHAINS + "SELECT * FROM chains")
def r1_build_chains(spark, sf):
    return rs.build_chains(long_versions(spark, sf))


@register("r1_build_chains_turns", S.F2_CHAINS + "SELECT * FROM chains")
def r1_build_chains_turns(spark, sf):
    return turn_chains(spark, sf)


@register("r2_dedup_first_turns", S.with_(S.turn_versions_cte()) + """
SELECT key, source, version_name, min(seq) AS seq, arg_min(text, seq) AS text FROM versions
GROUP BY key, source, version_name""")
def r2_dedup_first_turns(spark, sf):
    v = fx.turn_versions(spark, sf).select("key", "source", "version_name", "seq", "text")
    return rs.dedup_first(v, ["key", "source", "version_name"], ["seq"])


@register("r3_union_tagged", S.with_(S.versions_cte("v1"), S.turn_versions_cte("v2")) + """
SELECT 'documents' AS dataset, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM v1
UNION ALL
SELECT 'conversations', count(*), CAST(sum(length(text)) AS BIGINT) FROM v2""")
def r3_union_tagged(spark, sf):
    u = rs.union_tagged({"documents": fx.versions(spark, sf).drop("dataset"),
                         "conversations": fx.turn_versions(spark, sf).drop("dataset")})
    return u.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(F.length("text")).cast("long").alias("chars"))


@register("r4_melt_chains", S.F1_CHAINS + f"""
SELECT {CHS}, family, stage, CAST(length(text) AS BIGINT) AS n_chars FROM (
  UNPIVOT chains ON T0, T1, T2, T3 INTO NAME stage VALUE text)
WHERE NOT """ + S.blank('text'))
def r4_melt_chains(spark, sf):
    m = rs.melt_chains(chains(spark, sf), ids=CH + ["family"])
    return m.select(*CH, "family", "stage", F.length("text").cast("long").alias("n_chars"))


_RK = "md5(concat_ws(':', '64', dataset, key, source, paraphraser))"


@register("r5_sample_per_dataset", S.F1_CHAINS + f"""
SELECT {CHS} FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_RK}, {CHS}) AS rn FROM chains)
WHERE rn <= 50""")
def r5_sample_per_dataset(spark, sf):
    return rs.sample_n(chains(spark, sf), 50, CH, by=["dataset"], seed=64).select(*CH)


_RK42 = "md5(concat_ws(':', '42', dataset, key, source, paraphraser))"


@register("r6_balance_human_ai", S.F1_CHAINS + f"""
, lab AS (SELECT *, CASE WHEN source = 'Human' THEN 'Human' ELSE 'AI' END AS grp FROM chains),
m AS (SELECT min(c) AS k FROM (SELECT grp, count(*) AS c FROM lab GROUP BY grp))
SELECT {CHS}, grp FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_RK42}, {CHS}) AS rn FROM lab)
WHERE rn <= (SELECT k FROM m)""".replace("chains)\n, lab", "chains),\nlab"))
def r6_balance_human_ai(spark, sf):
    lab = chains(spark, sf).withColumn("grp", tx.source_group("source"))
    return rs.balance_classes(lab, "grp", CH, seed=42).select(*CH, "grp")


@register("r7_stratified_split", """
WITH x AS (SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY quality
        ORDER BY md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR))), doc_id) AS rn,
      count(*) OVER (PARTITION BY quality) AS c FROM x)
SELECT doc_id, quality, CASE WHEN rn <= ceil(c * 0.25) THEN 'test' ELSE 'train' END AS split FROM r""")
def r7_stratified_split(spark, sf):
    d = fx.labelled_documents(spark, sf).select("doc_id", "quality")
    return rs.stratified_split(d, "quality", ["doc_id"], 0.25, seed=42) \
        .select("doc_id", "quality", "split")


@register("r9_lookup_chain", S.F1_CHAINS + f"""
, hit AS (SELECT * FROM chains WHERE dataset = 'wp' AND key = 'wp-1' AND source = 'OpenAI'
          AND paraphraser = 'chatgpt'),
l AS (SELECT stage, min(text) AS text FROM (UNPIVOT hit ON T0, T1, T2, T3 INTO NAME stage VALUE text)
      GROUP BY stage),
s(stage) AS (VALUES ('T0'), ('T1'), ('T2'), ('T3'))
SELECT s.stage, l.text, CASE WHEN l.text IS NULL THEN CAST(0 AS BIGINT)
       ELSE {S.word_count('l.text')} END AS word_count, l.text IS NOT NULL AS found
FROM s LEFT JOIN l ON s.stage = l.stage""".replace("chains)\n, hit", "chains),\nhit"))
def r9_lookup_chain(spark, sf):
    return rs.lookup_chain(chains(spark, sf), "wp", "wp-1", "OpenAI", "chatgpt")


@register("r11_distinct_values", S.F1_CHAINS + """
SELECT 'dataset' AS col, dataset AS value FROM chains GROUP BY dataset
UNION ALL SELECT 'family', family FROM chains GROUP BY family
UNION ALL SELECT 'paraphraser', paraphraser FROM chains GROUP BY paraphraser
UNION ALL SELECT 'source', source FROM chains GROUP BY source""")
def r11_distinct_values(spark, sf):
    # one pass, without texts; the combinations that occur are stored, as each column reads them
    own = ["dataset", "family", "paraphraser", "source"]
    ch = stored(rs.chain_stages(long_versions(spark, sf)).select(*own).distinct(), "values")
    parts = [rs.distinct_values(ch, c).select(F.lit(c).alias("col"), F.col(c).alias("value"))
             for c in own]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------------------------
# C: corpus counts
# ---------------------------------------------------------------------------------------------


@register("c1_stage_counts", S.with_(S.versions_cte(), S.long_cte()) + """
SELECT dataset, """ + ", ".join(f"count(*) FILTER (WHERE stage = '{s}') AS {s}" for s in STAGES) +
    " FROM lv GROUP BY dataset")
def c1_stage_counts(spark, sf):
    return co.stage_counts(long_versions(spark, sf))


_STATS_SQL = S.with_(S.versions_cte(), S.long_cte()) + f"""
, st AS (SELECT dataset, stage, {S.word_count('text')} AS word_count,
     {S.word_count(S.remove_stopwords(S.clean_text('text')))} AS no_stop_word_count FROM lv)"""
_STATS_SQL = _STATS_SQL.replace("\n, st AS", ",\nst AS")


def _stats(spark, sf):
    lv = de.preprocess(long_versions(spark, sf))
    return de.text_stats(lv, keep=["dataset", "stage"])


@register("c2_word_count_distribution", _STATS_SQL + """
SELECT dataset, stage, q[1] AS q1, q[2] AS median, q[3] AS q3, """ + S.rnd("mean") + """ AS mean FROM (
  SELECT dataset, stage, quantile_cont(word_count, [0.25, 0.5, 0.75]) AS q, avg(word_count) AS mean
  FROM st GROUP BY dataset, stage)""")
def c2_word_count_distribution(spark, sf):
    return co.word_count_distribution(_stats(spark, sf)).withColumn("mean", rnd("mean"))


@register("c3_vocabulary_by_stage", _STATS_SQL + """
SELECT dataset, stage, """ + S.rnd("avg(word_count)") + " AS mean_word_count, " + S.rnd(
    "avg(no_stop_word_count)") + " AS mean_no_stop_count, " + S.rnd(
    "avg(word_count) - avg(no_stop_word_count)") + """ AS stopword_gap
FROM st GROUP BY dataset, stage""")
def c3_vocabulary_by_stage(spark, sf):
    v = co.vocabulary_by_stage(_stats(spark, sf))
    return v.select("dataset", "stage", *[rnd(c).alias(c) for c in
                                          ("mean_word_count", "mean_no_stop_count", "stopword_gap")])


@register("c4_chain_counts_dataset", S.F1_CHAINS +
          "SELECT dataset, count(*) AS n_chains FROM chains GROUP BY dataset")
def c4_chain_counts_dataset(spark, sf):
    return co.chain_counts(chains(spark, sf), "dataset")


@register("c4_chain_counts_family", S.F1_CHAINS +
          "SELECT family, count(*) AS n_chains FROM chains GROUP BY family")
def c4_chain_counts_family(spark, sf):
    return co.chain_counts(chains(spark, sf), "family")


@register("c5_corpus_stats", S.F1_CHAINS + """
, c AS (SELECT coalesce(dataset, 'total') AS dataset, count(*) AS n_chains,
          count(DISTINCT paraphraser) AS n_paraphrasers, count(DISTINCT key) AS n_documents
        FROM chains GROUP BY ROLLUP (dataset)),
v AS (SELECT coalesce(dataset, 'total') AS dataset, count(*) FILTER (WHERE stage = 'T0') AS t0_docs,
        count(*) AS total_rows FROM lv GROUP BY ROLLUP (dataset))
SELECT coalesce(c.dataset, v.dataset) AS dataset, n_chains, n_paraphrasers, n_documents, t0_docs,
       total_rows FROM c FULL JOIN v ON c.dataset = v.dataset""".replace("chains)\n, c AS",
                                                                        "chains),\nc AS"))
def c5_corpus_stats(spark, sf):
    lv = long_versions(spark, sf)
    return co.corpus_stats(rs.build_chains(lv), lv)


@register("c6_value_shares_source", S.F1_CHAINS + """
SELECT source, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent
FROM chains GROUP BY source""")
def c6_value_shares_source(spark, sf):
    return co.value_shares(chains(spark, sf), "source").withColumn("percent", rnd("percent"))


# ---------------------------------------------------------------------------------------------
# M: lexical similarity
# ---------------------------------------------------------------------------------------------

def _overlap_sql(metrics=("bleu", "rouge1", "rouge2"), rounded: bool = True) -> str:
    """SQL for M1-M3/M5: n-gram bags per chain, clipped matches, BLEU-2 / ROUGE-N formulas."""
    rd = S.rnd if rounded else (lambda x: x)
    stage_lists = []
    for i, s in enumerate(STAGES):
        parts = []
        if "bleu" in metrics:
            parts += [f"list_transform(b{i}, lambda x: 'a' || x)",
                      f"list_transform({S.bigrams(f'b{i}')}, lambda x: 'b' || x)"]
        if "rouge1" in metrics:
            parts.append(f"list_transform(r{i}, lambda x: 'c' || x)")
        if "rouge2" in metrics:
            parts.append(f"list_transform({S.bigrams(f'r{i}')}, lambda x: 'd' || x)")
        stage_lists.append(f"SELECT {CHS}, {i} AS s, unnest({' || '.join(parts)}) AS g FROM tk")
    kinds = (["a", "b"] if "bleu" in metrics else []) + (["c"] if "rouge1" in metrics else []) \
        + (["d"] if "rouge2" in metrics else [])
    msums = ", ".join(f"sum(CASE WHEN left(g, 1) = '{k}' THEN least(c0, c{i}) ELSE 0 END) AS m{k}{i}"
                      for k in kinds for i in (1, 2, 3))
    toks = ", ".join([f"{s} IS NOT NULL AS h{i}" for i, s in enumerate(STAGES)]
                     + [f"{S.bleu_tokens(s)} AS b{i}" for i, s in enumerate(STAGES)]
                     + [f"{S.rouge_tokens(s)} AS r{i}" for i, s in enumerate(STAGES)])
    outs = []
    for i, s in zip((1, 2, 3), LATER_STAGES):
        valid = f"h0 AND h{i}"
        if "bleu" in metrics:
            na, n0 = f"len(b{i})", "len(b0)"
            ma, mb = f"coalesce(ma{i}, 0)", f"coalesce(mb{i}, 0)"
            p1 = f"({ma} / greatest({na}, 1))"
            p2 = (f"(CASE WHEN {mb} > 0 THEN {mb} / greatest({na} - 1, 1) "
                  f"ELSE 0.1 / greatest({na} - 1, 1) END)")
            bp = f"(CASE WHEN {na} > {n0} THEN 1.0 ELSE exp(1 - {n0} / {na}) END)"
            outs.append(rd(f"CASE WHEN {valid} THEN (CASE WHEN {ma} = 0 THEN 0.0 "
                           f"ELSE {bp} * sqrt({p1} * {p2}) END) END") + f" AS bleu_{s}")
        for m, k, off in (("rouge1", "c", 0), ("rouge2", "d", 1)):
            if m in metrics:
                hyp, ref = f"greatest(len(r{i}) - {off}, 0)", f"greatest(len(r0) - {off}, 0)"
                mm = f"coalesce(m{k}{i}, 0)"
                p, r = f"({mm} / greatest({hyp}, 1))", f"({mm} / greatest({ref}, 1))"
                f1 = f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"
                outs.append(rd(f"CASE WHEN {valid} THEN {f1} END") + f" AS {m}_{s}")
    return S.F1_CHAINS.rstrip() + f""",
tk AS (SELECT {CHS}, family, {toks} FROM chains),
g AS ({' UNION ALL '.join(stage_lists)}),
c AS (SELECT {CHS}, g, """ + ", ".join(f"count(*) FILTER (WHERE s = {i}) AS c{i}" for i in range(4)) + f"""
      FROM g GROUP BY {CHS}, g),
m AS (SELECT {CHS}, {msums} FROM c GROUP BY {CHS})
SELECT tk.dataset, tk.key, tk.source, tk.paraphraser, tk.family, {', '.join(outs)}
FROM tk LEFT JOIN m ON tk.dataset = m.dataset AND tk.key = m.key AND tk.source = m.source
  AND tk.paraphraser = m.paraphraser"""


def _scored(spark, sf, metrics):
    sc = sm.score_chains(chains(spark, sf), metrics)
    return sc.select(*[rnd(c).alias(c) if c.rsplit("_", 1)[-1] in STAGES else F.col(c)
                       for c in sc.columns])


@register("m1_bleu2", _overlap_sql(("bleu",)))
def m1_bleu2(spark, sf):
    return _scored(spark, sf, ["bleu"])


@register("m2_rouge1", _overlap_sql(("rouge1",)))
def m2_rouge1(spark, sf):
    return _scored(spark, sf, ["rouge1"])


@register("m3_rouge2", _overlap_sql(("rouge2",)))
def m3_rouge2(spark, sf):
    return _scored(spark, sf, ["rouge2"])


def _rouge_l_sql() -> str:
    """On F1 every rewrite drops whole words, so its tokens are a subsequence of T0's, and the LCS
    is the rewrite's token count."""
    toks = ", ".join(f"{S.rouge_tokens(s)} AS r{i}" for i, s in enumerate(STAGES))
    outs = []
    for i, s in zip((1, 2, 3), LATER_STAGES):
        p, r = f"(CASE WHEN len(r{i}) > 0 THEN 1.0 ELSE 0.0 END)", f"(CASE WHEN len(r0) > 0 THEN len(r{i}) / len(r0) ELSE 0.0 END)"
        f1 = f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"
        outs.append(S.rnd(f"CASE WHEN T0 IS NOT NULL AND {s} IS NOT NULL THEN {f1} END") + f" AS rougeL_{s}")
    return S.F1_CHAINS + f"SELECT {CHS}, family, {', '.join(outs)} FROM (SELECT *, {toks} FROM chains)"


@register("m4_rouge_l", _rouge_l_sql())
def m4_rouge_l(spark, sf):
    return _scored(spark, sf, ["rougeL"])


def _lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence: one row of the table for each token of ``a``. In a
    row a cell is the greatest, up to there, of the cell above and, where tokens agree, the diagonal + 1."""
    cells = (f"list_transform({b}, lambda y, j: greatest(row[j], CASE WHEN y = x THEN coalesce(row[j - 1], 0) + 1 "
             "ELSE 0 END))")
    rows = f"list_transform([{cells}], lambda c: list_transform(c, lambda v, j: list_max(c[1:j])))[1]"
    last = f"list_reduce({a}, lambda row, x: {rows}, list_transform({b}, lambda y: 0))"
    return f"coalesce(({last})[-1], 0)"


def _rouge_l_turns_sql() -> str:
    toks = ", ".join(f"{S.rouge_tokens(s)} AS r{i}" for i, s in enumerate(STAGES))
    lcs = ", ".join(f"{_lcs_sql(f'r{i}', 'r0')} AS l{i}" for i in (1, 2, 3))
    outs = []
    for i, s in zip((1, 2, 3), LATER_STAGES):
        p, r = (f"(CASE WHEN len(r{k}) > 0 THEN l{i} / len(r{k}) ELSE 0.0 END)" for k in (i, 0))
        f1 = f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"
        outs.append(S.rnd(f"CASE WHEN T0 IS NOT NULL AND {s} IS NOT NULL THEN {f1} END") + f" AS rougeL_{s}")
    return (S.F2_CHAINS.rstrip() + f", tk AS (SELECT *, {toks} FROM chains), lc AS (SELECT *, {lcs} FROM tk) "
            f"SELECT {CHS}, family, {', '.join(outs)} FROM lc")


@register("m4_rouge_l_turns", _rouge_l_turns_sql())
def m4_rouge_l_turns(spark, sf):
    """ROUGE-L of conversation turns, where a later turn is not cut out of the first one."""
    sc = sm.rouge_l(turn_chains(spark, sf))
    return sc.select(*CH, "family", *[rnd(f"rougeL_{s}").alias(f"rougeL_{s}") for s in LATER_STAGES])


@register("m5_score_chains", _overlap_sql())
def m5_score_chains(spark, sf):
    return _scored(spark, sf, ["bleu", "rouge1", "rouge2"])


@register("m5_score_chains_all", f"SELECT a.*, {', '.join(f'b.rougeL_{s}' for s in LATER_STAGES)} FROM "
          f"({_overlap_sql()}) a JOIN ({_rouge_l_sql()}) b USING ({CHS})")
def m5_score_chains_all(spark, sf):
    return _scored(spark, sf, ["bleu", "rouge1", "rouge2", "rougeL"])


_M6_LABELS = "CASE metric WHEN 'bleu' THEN 'BLEU-2' WHEN 'rouge1' THEN 'ROUGE-1' " \
             "WHEN 'rouge2' THEN 'ROUGE-2' WHEN 'rougeL' THEN 'ROUGE-L' END"


def _m_base_sql(rounded: bool = True):
    full = _overlap_sql(rounded=rounded)
    cut = full.rindex("SELECT tk.dataset")
    head = full[:cut].rstrip()
    body = full[cut:]
    cols = ", ".join(f"{m}_{s}" for m in ("bleu", "rouge1", "rouge2") for s in LATER_STAGES)
    return head + f""",
scored AS ({body}),
sl AS (SELECT dataset, key, source, paraphraser, family, split_part(col, '_', 2) AS stage,
          split_part(col, '_', 1) AS metric, score
       FROM scored UNPIVOT INCLUDE NULLS (score FOR col IN ({cols})))
"""


def _m_all_sql() -> str:
    """``scored`` and ``sl`` with all four metrics."""
    cols = ", ".join(f"{m}_{s}" for m in sm.ALL_METRICS for s in LATER_STAGES)
    return f"""WITH scored AS ({ORACLE['m5_score_chains_all']}),
sl AS (SELECT dataset, key, source, paraphraser, family, split_part(col, '_', 2) AS stage,
          split_part(col, '_', 1) AS metric, score
       FROM scored UNPIVOT INCLUDE NULLS (score FOR col IN ({cols})))
"""


@register("m6_mean_scores_by_stage", _m_all_sql() + f"""
SELECT stage, {_M6_LABELS} AS metric, {S.rnd('avg(score)')} AS score FROM sl GROUP BY stage, metric""")
def m6_mean_scores_by_stage(spark, sf):
    return sm.mean_scores_by_stage(_scored(spark, sf, sm.ALL_METRICS)).withColumn("score", rnd("score"))


@register("m11_metric_by_stage_dataset", _m_all_sql() + """
SELECT dataset, metric, """ + ", ".join(
    S.r4e(f"avg(score) FILTER (WHERE stage = '{s}')") + f" AS {s}" for s in LATER_STAGES) + """
FROM sl GROUP BY dataset, metric""")
def m11_metric_by_stage_dataset(spark, sf):
    return sm.metric_by_stage(_scored(spark, sf, sm.ALL_METRICS), by=("dataset",), places=4)


@register("m12_decay_curve_family", _m_base_sql() + """
SELECT family, 1.0 AS T0, """ + ", ".join(
    S.rnd(f"avg(score) FILTER (WHERE stage = '{s}')") + f" AS {s}" for s in LATER_STAGES) + """
FROM sl WHERE metric = 'rouge1' GROUP BY family""")
def m12_decay_curve_family(spark, sf):
    sc = sm.score_chains(chains(spark, sf), ["rouge1"])
    sc = sc.select(*[rnd(c).alias(c) if c.rsplit("_", 1)[-1] in STAGES else F.col(c)
                     for c in sc.columns])
    d = sm.decay_curve(sc, "rouge1", "family")
    return d.select("family", "T0", *[rnd(s).alias(s) for s in LATER_STAGES])


@register("m11_metric_by_stage_dataset_paraphraser", _m_all_sql() + """
SELECT dataset, paraphraser, metric, """ + ", ".join(
    S.r4e(f"avg(score) FILTER (WHERE stage = '{s}')") + f" AS {s}" for s in LATER_STAGES) + """
FROM sl GROUP BY dataset, paraphraser, metric""")
def m11_metric_by_stage_dataset_paraphraser(spark, sf):
    return sm.metric_by_stage(_scored(spark, sf, sm.ALL_METRICS), by=("dataset", "paraphraser"), places=4)


@register("m11_metric_by_stage_family", _m_all_sql() + """
SELECT family, metric, """ + ", ".join(
    S.r4e(f"avg(score) FILTER (WHERE stage = '{s}')") + f" AS {s}" for s in LATER_STAGES) + """
FROM sl GROUP BY family, metric""")
def m11_metric_by_stage_family(spark, sf):
    return sm.metric_by_stage(_scored(spark, sf, sm.ALL_METRICS), by=("family",), places=4)


@register("m12_decay_curve_dataset", _m_base_sql() + """
SELECT dataset, 1.0 AS T0, """ + ", ".join(
    S.rnd(f"avg(score) FILTER (WHERE stage = '{s}')") + f" AS {s}" for s in LATER_STAGES) + """
FROM sl WHERE metric = 'bleu' GROUP BY dataset""")
def m12_decay_curve_dataset(spark, sf):
    d = sm.decay_curve(_scored(spark, sf, ["bleu"]), "bleu", "dataset")
    return d.select("dataset", "T0", *[rnd(s).alias(s) for s in LATER_STAGES])


def _curves_sql(by: str) -> str:
    means = ", ".join(S.rnd(f"avg(score) FILTER (WHERE stage = '{s}')") + f" AS {s}" for s in LATER_STAGES)
    return _m_all_sql() + f"SELECT {by}, metric, 1.0 AS T0, {means} FROM sl GROUP BY {by}, metric"


def _curves(spark, sf, by):
    d = sm.decay_curves(_scored(spark, sf, sm.ALL_METRICS), by)
    return d.select(by, "metric", "T0", *[rnd(s).alias(s) for s in LATER_STAGES])


@register("m12_decay_curves_family", _curves_sql("family"))
def m12_decay_curves_family(spark, sf):
    return _curves(spark, sf, "family")


@register("m12_decay_curves_dataset", _curves_sql("dataset"))
def m12_decay_curves_dataset(spark, sf):
    return _curves(spark, sf, "dataset")


@register("r10_nth_document", _m_all_sql() + f"""
SELECT dataset, family, key, source, paraphraser, bleu_T3, rouge1_T3, rouge2_T3, rougeL_T3 FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, family ORDER BY key, source, paraphraser) AS rn
  FROM scored) WHERE rn = 3""")
def r10_nth_document(spark, sf):
    picked = rs.nth_document(chains(spark, sf), 3, order_cols=("key", "source", "paraphraser"))
    sc = sm.score_chains(picked, sm.ALL_METRICS)
    return sc.select("dataset", "family", "key", "source", "paraphraser",
                     *[rnd(c).alias(c) for c in ("bleu_T3", "rouge1_T3", "rouge2_T3", "rougeL_T3")])


@register("p12_round4_rouge1", _m_base_sql(rounded=False) + """
SELECT dataset, key, source, paraphraser, """ + ", ".join(
    S.r4e(f"rouge1_{s}") + f" AS rouge1_{s}" for s in LATER_STAGES) + " FROM scored")
def p12_round4_rouge1(spark, sf):
    sc = sm.score_chains(chains(spark, sf), ["rouge1"])
    return de.round_metrics(sc.select(*CH, *[f"rouge1_{s}" for s in LATER_STAGES]),
                            [f"rouge1_{s}" for s in LATER_STAGES], 4)


def queries() -> dict:
    from textdrift.plans import catalog_more, catalog_sources, catalog_tables  # noqa: F401  (register the rest)
    return dict(QUERIES)


def oracle_sql() -> dict:
    from textdrift.plans import catalog_more, catalog_sources, catalog_tables  # noqa: F401
    return dict(ORACLE)

"""Second half of the registered queries: entities, style, embeddings, learning, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.constants import (KEY_PARAPHRASERS, LATER_STAGES, MAIN_POS, SCALAR_FEATURES,
                                 STAGES, TRACKED_POS, UPOS_TAGS)
from textdrift.functions import text as tx
from textdrift.operators import audit as au
from textdrift.operators import entities as en
from textdrift.operators import learn as le
from textdrift.operators import reshape as rs
from textdrift.operators import similarity as sm
from textdrift.operators import style as sy
from textdrift.plans import sql as S
from textdrift.session import stored
from textdrift.plans.catalog import (CH, CHS, VK, VKS, chains, long_versions,
                                     register, rnd)
from textdrift.sources import fixtures as fx

RM = en.RETENTION_METRICS
DBL = ("jaccard", "recall", "precision")


def _rnd_all(df: DataFrame, cols) -> DataFrame:
    return df.select(*[rnd(c).alias(c) if c in set(cols) else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------------------------
# E: entities
# ---------------------------------------------------------------------------------------------

_ENT_BASE = S.with_(S.versions_cte(), S.long_cte(),
                    f"ev AS (SELECT *, {S.entity_set('text')} AS ents FROM lv)",
                    S.chains_cte("ev", "chains", values=("ents",)),
                    "nc AS (SELECT " + CHS + ", family, T0, T1, T2, T3, " + ", ".join(
                        f"coalesce(ents_{s}, []) AS ner_{s}" for s in STAGES) + " FROM chains)")


def _ret_long_sql() -> str:
    parts = []
    for s in LATER_STAGES:
        ex = S.retention_exprs("ner_T0", f"ner_{s}")
        parts.append(f"SELECT {CHS}, family, '{s}' AS stage, " + ", ".join(
            f"{ex[m]} AS {m}" for m in RM) + " FROM nc")
    return _ENT_BASE.rstrip() + ",\nret AS (" + " UNION ALL ".join(parts) + ")\n"


_RET = _ret_long_sql()


def _ner_chains(spark, sf):
    return en.entities_for_chains(long_versions(spark, sf))


def _ret(spark, sf):
    return en.retention_long(_ner_chains(spark, sf))


@register("e1_entity_sets", S.with_(S.versions_cte()) +
          f"SELECT {VKS}, {S.sorted_join(S.entity_set('text'))} AS entities FROM versions")
def e1_entity_sets(spark, sf):
    v = fx.versions(spark, sf, in_batches=True)
    return v.select(*VK, F.array_join(F.array_sort(en.entity_set("text")), "|").alias("entities"))


_TYPED_SQL = (f"list_distinct(list_transform({S.tokens(S.guard('text'), en.MENTION_RE)}, "
              f"lambda m: lower(trim(m)) || '#' || {S.mention_label('m')}))")


@register("e2_entity_sets_typed", S.with_(S.versions_cte()) +
          f"SELECT {VKS}, {S.sorted_join(_TYPED_SQL)} AS entities FROM versions")
def e2_entity_sets_typed(spark, sf):
    v = fx.versions(spark, sf, in_batches=True)
    typed = F.transform(en.entity_set_typed("text"),
                        lambda x: F.concat(x["text"], F.lit("#"), x["label"]))
    return v.select(*VK, F.array_join(F.array_sort(typed), "|").alias("entities"))


@register("e3_retention_long", _RET + f"SELECT {CHS}, family, stage, " + ", ".join(
    S.rnd(m) + f" AS {m}" if m in DBL else m for m in RM) + " FROM ret")
def e3_retention_long(spark, sf):
    return _rnd_all(_ret(spark, sf), DBL)


@register("e4_entities_for_chains", _ENT_BASE + f"SELECT {CHS}, family, " + ", ".join(
    f"{S.sorted_join(f'ner_{s}')} AS ner_{s}" for s in STAGES) + " FROM nc")
def e4_entities_for_chains(spark, sf):
    nc = _ner_chains(spark, sf)
    return nc.select(*CH, "family", *[F.array_join(F.array_sort(f"ner_{s}"), "|").alias(f"ner_{s}")
                                      for s in STAGES])


def _e5_sql() -> str:
    cols = []
    for s in LATER_STAGES:
        ex = S.retention_exprs("ner_T0", f"ner_{s}")
        cols += [(S.rnd(ex[m]) if m in DBL else ex[m]) + f" AS {m}_{s}" for m in RM]
    return _ENT_BASE + f"SELECT {CHS}, family, " + ", ".join(cols) + " FROM nc"


@register("e5_retention_for_chains", _e5_sql())
def e5_retention_for_chains(spark, sf):
    w = en.retention_for_chains(_ner_chains(spark, sf))
    return _rnd_all(w, [f"{m}_{s}" for m in DBL for s in LATER_STAGES])


@register("e6_retention_summary", _RET + "SELECT stage, " + ", ".join(
    S.rnd(f"avg({m})") + f" AS {m}" for m in DBL) + ", " + S.rnd("avg(n_ref)") +
    " AS mean_t0_entities, " + S.rnd("avg(n_hyp)") + " AS mean_tn_entities FROM ret GROUP BY stage")
def e6_retention_summary(spark, sf):
    s = en.retention_summary(_ret(spark, sf))
    return _rnd_all(s, list(DBL) + ["mean_t0_entities", "mean_tn_entities"])


_E7_COLS = ", ".join(f"avg({m}) AS {m}" for m in DBL) + ", avg(n_ref) AS mean_t0_entities"


@register("e7_retention_by_domain", _RET + f", dom AS (SELECT dataset, stage, {_E7_COLS} FROM ret "
          "GROUP BY dataset, stage)\nSELECT dataset, stage, " + ", ".join(
              S.rnd(m) + f" AS {m}" for m in list(DBL) + ["mean_t0_entities"]) + " FROM dom")
def e7_retention_by_domain(spark, sf):
    return _rnd_all(en.retention_by_domain(_ret(spark, sf)), list(DBL) + ["mean_t0_entities"])


@register("e8_retention_macro", _RET + f", dom AS (SELECT dataset, stage, {_E7_COLS} FROM ret "
          "GROUP BY dataset, stage)\nSELECT stage, " + ", ".join(
              S.rnd(f"avg({m})") + f" AS {m}" for m in DBL) + " FROM dom GROUP BY stage")
def e8_retention_macro(spark, sf):
    return _rnd_all(en.retention_macro(en.retention_by_domain(_ret(spark, sf))), DBL)


_CAP = "upper(left(family, 1)) || lower(substr(family, 2))"


@register("e9_retention_by_family", _RET + f"SELECT {_CAP} AS family, stage, " + ", ".join(
    S.rnd(f"avg({m})") + f" AS {m}" for m in DBL) +
    " , count(*) AS n FROM ret WHERE family NOT IN ('none', 'unknown') GROUP BY family, stage")
def e9_retention_by_family(spark, sf):
    return _rnd_all(en.retention_by_family(_ret(spark, sf)), DBL)


@register("e10_drop_vs_hallucinate", _RET + """
SELECT 'family' AS level, family AS name, """ + S.rnd("avg(recall)") + " AS recall, " +
    S.rnd("avg(precision)") + """ AS precision, count(*) AS n FROM ret WHERE stage = 'T3' GROUP BY family
UNION ALL
SELECT 'paraphraser', paraphraser, """ + S.rnd("avg(recall)") + ", " + S.rnd("avg(precision)") +
    """, count(*) FROM ret WHERE stage = 'T3' GROUP BY paraphraser HAVING count(*) >= 10""")
def e10_drop_vs_hallucinate(spark, sf):
    return _rnd_all(en.drop_vs_hallucinate(_ret(spark, sf)), ("recall", "precision"))


@register("e11_t3_domain_ranking", _RET + f", dom AS (SELECT dataset, stage, {_E7_COLS} FROM ret "
          "GROUP BY dataset, stage)\nSELECT dataset, " + ", ".join(
              S.rnd(m) + f" AS {m}" for m in DBL) + " FROM dom WHERE stage = 'T3'")
def e11_t3_domain_ranking(spark, sf):
    return _rnd_all(en.t3_domain_ranking(en.retention_by_domain(_ret(spark, sf))), DBL)


_VARIANTS = ", ".join(f"({S.q(f.capitalize())}, {S.q(p)}, {S.q(lv)})"
                      for f, p, lv in en.INTENSITY_VARIANTS)


@register("e12_intensity_comparison", _RET + f", var(family_label, variant, intensity) AS "
          f"(VALUES {_VARIANTS})\nSELECT var.family_label AS family, var.variant, var.intensity, "
          "ret.stage, " + ", ".join(S.rnd(f"avg(ret.{m})") + f" AS {m}" for m in DBL) +
          ", count(*) AS n FROM ret JOIN var ON ret.paraphraser = var.variant "
          "GROUP BY var.family_label, var.variant, var.intensity, ret.stage")
def e12_intensity_comparison(spark, sf):
    return _rnd_all(en.intensity_comparison(_ret(spark, sf)), DBL)


@register("e13_worst_families", _RET + f"SELECT {_CAP} AS family, " + S.rnd("avg(recall)") +
          " AS recall, " + S.rnd("avg(precision)") + " AS precision FROM ret WHERE stage = 'T3' "
          "AND family NOT IN ('none', 'unknown') GROUP BY family")
def e13_worst_families(spark, sf):
    return _rnd_all(en.worst_families(en.retention_by_family(_ret(spark, sf))),
                   ("recall", "precision"))


# ---------------------------------------------------------------------------------------------
# Y: style
# ---------------------------------------------------------------------------------------------

def _tag_sql(tags) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE tag = '{t}') AS c_{t}" for t in tags)
    return f"""tok AS (
  SELECT {VKS}, unnest(t) AS token, generate_subscripts(t, 1) AS pos
  FROM (SELECT {VKS}, {S.tokens(S.guard('text'), sy.TOKEN_RE)} AS t FROM versions)),
lex(word, lex_tag) AS (VALUES {S.lexicon_values()}),
tagged AS (SELECT tok.*, {S.rule_tag('tok.token', 'lex.lex_tag')} AS tag
           FROM tok LEFT JOIN lex ON lower(tok.token) = lex.word),
dist AS (SELECT {VKS}, count(*) AS n_tok, max(pos) AS max_pos,
           avg(floor(log2(pos))) AS dep_mean, {counts} FROM tagged GROUP BY {VKS})"""


def _features_sql(tags=TRACKED_POS) -> str:
    """Per-version feature table ``feat`` (same columns as style.style_features)."""
    sl = S.sentence_lengths("v.text")
    tf = S.text_feature_exprs("v.text")
    blank = S.blank("v.text")

    def scal(e):
        return f"CASE WHEN {blank} THEN 0.0 ELSE {S.r4e(f'coalesce({e}, 0.0)')} END"

    shares = ", ".join(
        f"CASE WHEN {blank} OR d.n_tok IS NULL THEN 0.0 ELSE d.c_{t} / d.n_tok END AS pos_{t}"
        for t in tags)
    return _tag_sql(tags) + f""",
sent AS (SELECT {', '.join('v.' + c for c in VK)}, v.text, {sl} AS sl FROM versions v),
feat AS (
  SELECT {', '.join('v.' + c for c in VK)}, v.text IS NOT NULL AS present,
    {scal("CASE WHEN len(v.sl) > 0 THEN list_sum(v.sl) / len(v.sl) ELSE 0.0 END")} AS sent_len_mean,
    {scal(S.SENT_VAR.format(sl="v.sl"))} AS sent_len_var,
    {scal(tf['ttr'])} AS ttr, {scal(tf['punct_ratio'])} AS punct_ratio,
    {scal('d.dep_mean')} AS dep_depth_mean,
    {scal('CAST(floor(log2(d.max_pos)) AS DOUBLE)')} AS dep_depth_max, {shares}
  FROM sent v LEFT JOIN dist d ON {' AND '.join(f'v.{c} = d.{c}' for c in VK)})"""


def _features(spark, sf, tags=TRACKED_POS, with_depth=True, scalars=SCALAR_FEATURES):
    return sy.style_features(fx.versions(spark, sf, in_batches=True), tags=tags, with_depth=with_depth, scalars=scalars)


POS16 = [f"pos_{t}" for t in TRACKED_POS]


@register("y1_sentence_length", S.with_(S.versions_cte()) + f"""
SELECT {VKS}, {S.rnd("CASE WHEN len(sl) > 0 THEN list_sum(sl) / len(sl) ELSE 0.0 END")} AS sent_len_mean,
  {S.rnd(S.SENT_VAR.format(sl="sl"))} AS sent_len_var
FROM (SELECT *, {S.sentence_lengths('text')} AS sl FROM versions)""")
def y1_sentence_length(spark, sf):
    v = fx.versions(spark, sf, in_batches=True).select(*VK, sy.sentence_length("text").alias("_sl"))
    mean, var = sy.sentence_moments(F.col("_sl"))
    return v.select(*VK, rnd(mean).alias("sent_len_mean"), rnd(var).alias("sent_len_var"))


_TF = S.text_feature_exprs("text")


@register("y2_type_token_ratio", S.with_(S.versions_cte()) +
          f"SELECT {VKS}, {S.rnd(_TF['ttr'])} AS ttr FROM versions")
def y2_type_token_ratio(spark, sf):
    return fx.versions(spark, sf, in_batches=True).select(*VK, rnd(sy.type_token_ratio("text")).alias("ttr"))


@register("y3_punct_ratio", S.with_(S.versions_cte()) +
          f"SELECT {VKS}, {S.rnd(_TF['punct_ratio'])} AS punct_ratio FROM versions")
def y3_punct_ratio(spark, sf):
    return fx.versions(spark, sf, in_batches=True).select(*VK, rnd(sy.punct_ratio("text")).alias("punct_ratio"))


@register("y4_tag_distribution", S.with_(S.versions_cte(), _features_sql()) +
          f"SELECT {VKS}, " + ", ".join(S.rnd(c) + f" AS {c}" for c in POS16) + " FROM feat")
def y4_tag_distribution(spark, sf):
    f = _features(spark, sf, scalars=())
    return _rnd_all(f.select(*VK, *POS16), POS16)


@register("y5_tree_depth", S.with_(S.versions_cte(), _features_sql()) +
          f"SELECT {VKS}, dep_depth_mean, dep_depth_max FROM feat")
def y5_tree_depth(spark, sf):
    return _features(spark, sf, (), scalars=["dep_depth_mean", "dep_depth_max"]).select(*VK, "dep_depth_mean", "dep_depth_max")


@register("y5_tree_depth_heads", f"""
WITH RECURSIVE d AS (SELECT doc_id, {S.tokens(S.guard('text'), sy.TOKEN_RE)} AS t FROM documents),
tok AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM d),
heads AS (SELECT doc_id, pos, greatest(1, pos // (2 + length(token) % 3)) AS head FROM tok),
walk(doc_id, pos, node, n) AS (SELECT doc_id, pos, pos, 0 FROM heads UNION ALL
  SELECT w.doc_id, w.pos, h.head, w.n + 1 FROM walk w JOIN heads h ON h.doc_id = w.doc_id AND h.pos = w.node
  WHERE h.head <> h.pos),
far AS (SELECT doc_id, pos, max(n) AS n FROM walk GROUP BY doc_id, pos)
SELECT doc_id, {S.rnd('avg(n)')} AS dep_depth_mean, CAST(max(n) AS DOUBLE) AS dep_depth_max FROM far GROUP BY doc_id""")
def y5_tree_depth_heads(spark, sf):
    """Y5 on a head table that depends on the tokens: head = pos div (2 + token length mod 3)."""
    docs = fx.read_table(spark, sf, "documents")
    tok = docs.select("doc_id", F.posexplode(tx.tokens(tx.guard_text("text"), sy.TOKEN_RE)).alias("i", "token"))
    pos = F.col("i") + 1
    head = F.greatest(F.lit(1), F.floor(pos / (2 + F.length("token") % 3)))
    ann = tok.select("doc_id", pos.alias("pos"), head.alias("head"))
    return sy.tree_depth(ann, ["doc_id"]).withColumn("dep_depth_mean", rnd("dep_depth_mean"))


@register("y6_style_features", S.with_(S.versions_cte(), _features_sql()) +
          f"SELECT {VKS}, present, " + ", ".join(SCALAR_FEATURES) + ", " +
          ", ".join(S.rnd(c) + f" AS {c}" for c in POS16) + " FROM feat")
def y6_style_features(spark, sf):
    return _rnd_all(_features(spark, sf), POS16)


def _fchains_sql(tags=TRACKED_POS) -> str:
    """Feature chains in SQL: chains of present versions, each stage joined to its features."""
    cols = SCALAR_FEATURES + [f"pos_{t}" for t in tags]
    return S.with_(S.versions_cte(), _features_sql(tags), S.long_cte("versions", "lv"),
                   S.chains_cte("lv", "chains")).rstrip() + f""",
cs AS (
  SELECT c.{', c.'.join(CH)}, c.family, s.stage, CASE s.stage WHEN 'T0' THEN 'original'
    ELSE c.paraphraser END AS vp
  FROM chains c, (VALUES ('T0'), ('T1'), ('T2'), ('T3')) s(stage)
  WHERE (s.stage = 'T0' AND c.T0 IS NOT NULL) OR (s.stage = 'T1' AND c.T1 IS NOT NULL)
     OR (s.stage = 'T2' AND c.T2 IS NOT NULL) OR (s.stage = 'T3' AND c.T3 IS NOT NULL)),
fl AS (SELECT lv.dataset, lv.key, lv.source, lv.paraphraser, lv.stage, arg_min(
         {{{', '.join(f"'{c}': feat.{c}" for c in cols)}}}, lv.seq) AS f
       FROM lv JOIN feat ON {' AND '.join(f'lv.{c} = feat.{c}' for c in VK)}
       GROUP BY lv.dataset, lv.key, lv.source, lv.paraphraser, lv.stage),
fs AS (SELECT cs.*, {', '.join(f'fl.f.{c} AS {c}' for c in cols)}
       FROM cs JOIN fl ON cs.dataset = fl.dataset AND cs.key = fl.key AND cs.source = fl.source
        AND cs.vp = fl.paraphraser AND cs.stage = fl.stage)
"""


def _fchains(spark, sf, tags=TRACKED_POS, scalars=()):
    """Chains of those features alone that a query reports."""
    return sy.feature_chains(_features(spark, sf, tags, scalars=scalars), tags, scalars)


@register("y7_features_by_stage", _fchains_sql() + "SELECT dataset, stage, " + ", ".join(
    S.rnd(f"avg({c})") + f" AS {c}" for c in SCALAR_FEATURES + POS16) +
    " FROM fs GROUP BY dataset, stage")
def y7_features_by_stage(spark, sf):
    return _rnd_all(sy.features_by_stage(_fchains(spark, sf, scalars=SCALAR_FEATURES)), SCALAR_FEATURES + POS16)


def _vec(stage_alias: str, tags) -> str:
    return "[" + ", ".join(f"coalesce({stage_alias}.pos_{t}, 0.0)" for t in tags) + "]"


def _pairs_sql(tags=TRACKED_POS) -> str:
    """Chain-level pairs T0 vs Tn of tag vectors (missing stage -> zero vector)."""
    return _fchains_sql(tags).rstrip() + f""",
pr AS (
  SELECT c.{', c.'.join(CH)}, c.family, s.stage, {_vec('a', tags)} AS v0, {_vec('b', tags)} AS vn
  FROM chains c CROSS JOIN (VALUES ('T1'), ('T2'), ('T3')) s(stage)
  LEFT JOIN fs a ON a.dataset = c.dataset AND a.key = c.key AND a.source = c.source
    AND a.paraphraser = c.paraphraser AND a.stage = 'T0'
  LEFT JOIN fs b ON b.dataset = c.dataset AND b.key = c.key AND b.source = c.source
    AND b.paraphraser = c.paraphraser AND b.stage = s.stage),
pc AS (SELECT *, CASE WHEN sqrt(list_dot_product(v0, v0)) * sqrt(list_dot_product(vn, vn)) > 0
         THEN list_dot_product(v0, vn) / (sqrt(list_dot_product(v0, v0)) * sqrt(list_dot_product(vn, vn)))
         END AS pos_cosine FROM pr)
"""


def _js_sql(a: str, b: str, n: int) -> str:
    pa = f"list_transform({a}, lambda x: x + 1e-10)"
    pb = f"list_transform({b}, lambda x: x + 1e-10)"
    sa, sb = f"list_sum({pa})", f"list_sum({pb})"
    terms = (f"list_transform(range(1, {n} + 1), lambda i: "
             f"(({pa}[i] / {sa}) * ln(({pa}[i] / {sa}) / ((({pa}[i] / {sa}) + ({pb}[i] / {sb})) / 2)) + "
             f"({pb}[i] / {sb}) * ln(({pb}[i] / {sb}) / ((({pa}[i] / {sa}) + ({pb}[i] / {sb})) / 2))) / 2)")
    return f"sqrt(greatest(list_sum({terms}), 0.0))"


@register("y8_pos_js_distance", _pairs_sql() + f"SELECT {CHS}, family, stage, " +
          S.rnd(_js_sql("v0", "vn", len(TRACKED_POS))) + " AS js_distance FROM pc")
def y8_pos_js_distance(spark, sf):
    fc = _fchains(spark, sf)
    zero = F.array(*[F.lit(0.0) for _ in TRACKED_POS])

    def vec(s):
        return F.when(F.col(f"f_{s}").isNull(), zero).otherwise(
            F.array(*[F.col(f"f_{s}.pos_{t}") for t in TRACKED_POS]))

    arr = F.array(*[F.struct(F.lit(s).alias("stage"), sy.pos_js_distance(vec("T0"), vec(s))
                             .alias("js_distance")) for s in LATER_STAGES])
    return _rnd_all(fc.select(*CH, "family", F.inline(arr)), ["js_distance"])


@register("y9_pos_cosine", _pairs_sql() + f"SELECT {CHS}, family, stage, " +
          S.rnd("pos_cosine") + " AS pos_cosine FROM pc")
def y9_pos_cosine(spark, sf):
    return _rnd_all(sy.pos_cosine_long(_fchains(spark, sf)), ["pos_cosine"])


@register("y10_mean_pos_cosine_by_stage", _pairs_sql() +
          "SELECT 'T0' AS stage, 1.0 AS pos_cosine UNION ALL SELECT stage, " +
          S.rnd("avg(pos_cosine)") + " FROM pc GROUP BY stage")
def y10_mean_pos_cosine_by_stage(spark, sf):
    return _rnd_all(sy.mean_pos_cosine_by_stage(_fchains(spark, sf)), ["pos_cosine"])


_Y11 = "SELECT stage, " + ", ".join(f"avg({c}) AS {c}" for c in SCALAR_FEATURES) + \
    " FROM fs GROUP BY stage"


@register("y11_feature_summary_by_stage", _fchains_sql() + "SELECT stage, " + ", ".join(
    S.rnd(f"avg({c})") + f" AS {c}" for c in SCALAR_FEATURES) + " FROM fs GROUP BY stage")
def y11_feature_summary_by_stage(spark, sf):
    return _rnd_all(sy.feature_summary_by_stage(_fchains(spark, sf, (), SCALAR_FEATURES)), SCALAR_FEATURES)


@register("y12_normalise_to_t0", _fchains_sql().rstrip() + f",\nsm AS ({_Y11})\nSELECT sm.stage, " +
          ", ".join(S.rnd(f"CASE WHEN t0.{c} <> 0 THEN sm.{c} / t0.{c} END") + f" AS {c}"
                    for c in SCALAR_FEATURES) +
          " FROM sm, (SELECT * FROM sm WHERE stage = 'T0') t0")
def y12_normalise_to_t0(spark, sf):
    return _rnd_all(sy.normalise_to_t0(sy.feature_summary_by_stage(_fchains(spark, sf, (), SCALAR_FEATURES))),
                   SCALAR_FEATURES)


@register("y13_pos_by_stage", _fchains_sql().rstrip() + ",\nm AS (SELECT stage, " + ", ".join(
    f"avg(pos_{t}) AS {t}" for t in MAIN_POS) + " FROM fs GROUP BY stage),\nu AS (" +
    " UNION ALL ".join(f"SELECT '{t}' AS tag, stage, {t} AS share FROM m" for t in MAIN_POS) +
    ")\nSELECT u.tag, u.stage, " + S.rnd("u.share") + " AS share, " +
    S.rnd("u.share - t0.share") + " AS delta FROM u JOIN u t0 ON t0.tag = u.tag AND t0.stage = 'T0'")
def y13_pos_by_stage(spark, sf):
    return _rnd_all(sy.pos_by_stage(_fchains(spark, sf, MAIN_POS)), ["share", "delta"])


def _y14_sql() -> str:
    idx = {t: i for i, t in enumerate(MAIN_POS)}
    widen = lambda v: "[" + ", ".join(f"{v}[{idx[t] + 1}]" if t in idx else "0.0"
                                      for t in TRACKED_POS) + "]"
    return _fchains_sql().rstrip() + ",\nmv AS (SELECT dataset, stage, [" + ", ".join(
        f"avg(pos_{t})" for t in MAIN_POS) + "] AS v FROM fs GROUP BY dataset, stage)\n" + \
        "SELECT m.dataset, m.stage, " + S.rnd(
            f"CASE WHEN m.stage = 'T0' THEN 0.0 ELSE {_js_sql(widen('t0.v'), widen('m.v'), 16)} END"
        ) + " AS js_distance FROM mv m JOIN mv t0 ON t0.dataset = m.dataset AND t0.stage = 'T0'"


@register("y14_pos_drift_by_dataset", _y14_sql())
def y14_pos_drift_by_dataset(spark, sf):
    return _rnd_all(sy.pos_drift_by_dataset(_fchains(spark, sf, MAIN_POS)), ["js_distance"])


_GRP = "CASE WHEN source = 'Human' THEN 'Human' ELSE 'LLM' END"


@register("y15_human_vs_llm_drift", _pairs_sql(UPOS_TAGS).rstrip() + f""",
x AS (SELECT *, {_GRP} AS grp FROM pc WHERE stage = 'T1'),
cell AS (SELECT dataset, grp, paraphraser, family, avg(pos_cosine) AS mean,
           stddev_samp(pos_cosine) AS std, count(*) AS n FROM x GROUP BY ALL)
SELECT 'cell' AS level, dataset, grp, paraphraser, family, {S.rnd('mean')} AS mean, {S.rnd('std')} AS std, n
FROM cell
UNION ALL SELECT 'group', NULL, grp, NULL, NULL, {S.rnd('avg(pos_cosine)')}, {S.rnd('stddev_samp(pos_cosine)')},
  count(*) FROM x GROUP BY grp
UNION ALL SELECT 'para_mean_of_means', NULL, grp, paraphraser, NULL, {S.rnd('avg(mean)')}, NULL, count(*)
  FROM cell GROUP BY paraphraser, grp
UNION ALL SELECT 'para_direct', NULL, grp, paraphraser, NULL, {S.rnd('avg(pos_cosine)')}, NULL, count(*)
  FROM x WHERE paraphraser IN ({', '.join(S.q(p) for p in KEY_PARAPHRASERS)})
  GROUP BY paraphraser, grp""")
def y15_human_vs_llm_drift(spark, sf):
    fc = _fchains(spark, sf, UPOS_TAGS)
    return _rnd_all(sy.human_vs_llm_drift(fc), ["mean", "std"])


@register("y16_distribution_by_stage", _fchains_sql().rstrip() + """,
q AS (SELECT stage, quantile_cont(dep_depth_mean, [0.25, 0.5, 0.75]) AS q FROM fs GROUP BY stage)
SELECT fs.stage, """ + ", ".join([
    S.rnd("any_value(q.q[1])") + " AS q1", S.rnd("any_value(q.q[2])") + " AS median",
    S.rnd("any_value(q.q[3])") + " AS q3",
    S.rnd("min(dep_depth_mean) FILTER (WHERE dep_depth_mean >= q.q[1] - 1.5 * (q.q[3] - q.q[1]))")
    + " AS whisker_low",
    S.rnd("max(dep_depth_mean) FILTER (WHERE dep_depth_mean <= q.q[3] + 1.5 * (q.q[3] - q.q[1]))")
    + " AS whisker_high", S.rnd("avg(dep_depth_mean)") + " AS mean", "count(*) AS n"]) +
    " FROM fs JOIN q ON fs.stage = q.stage GROUP BY fs.stage")
def y16_distribution_by_stage(spark, sf):
    long = sy.features_by_stage_long(_fchains(spark, sf, (), ["dep_depth_mean"]))
    d = sy.distribution_by_stage(long, "dep_depth_mean")
    return _rnd_all(d, ["q1", "median", "q3", "whisker_low", "whisker_high", "mean"])


# ---------------------------------------------------------------------------------------------
# embeddings
# ---------------------------------------------------------------------------------------------

_EMB = f"""WITH e AS (SELECT vec_id // 2 AS pair_id, vec_id % 2 AS side,
                 CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT pair_id, any_value(v) FILTER (WHERE side = 0) AS ref_vec,
        any_value(v) FILTER (WHERE side = 1) AS hyp_vec FROM e GROUP BY pair_id),
c AS (SELECT pair_id, {S.case_mod('pair_id', 7, fx.F1_DATASETS)} AS dataset,
        'T' || CAST(pair_id % 3 + 1 AS VARCHAR) AS stage,
        CASE WHEN sqrt(list_dot_product(ref_vec, ref_vec)) * sqrt(list_dot_product(hyp_vec, hyp_vec)) > 0
          THEN list_dot_product(ref_vec, hyp_vec) /
               (sqrt(list_dot_product(ref_vec, ref_vec)) * sqrt(list_dot_product(hyp_vec, hyp_vec)))
        END AS cosine, ref_vec IS NOT NULL AS has_ref, hyp_vec IS NOT NULL AS has_hyp FROM p)
"""


@register("m7_embedding_cosine", _EMB + f"SELECT pair_id, dataset, stage, {S.rnd('cosine')} AS cosine FROM c")
def m7_embedding_cosine(spark, sf):
    p = sm.embedding_cosine(fx.embedding_pairs(spark, sf))
    return _rnd_all(p.select("pair_id", "dataset", "stage", "cosine"), ["cosine"])


@register("m8_mean_embedding_cosine", _EMB + """, g AS (
  SELECT dataset, stage, avg(cosine) AS score FROM c WHERE has_ref AND has_hyp GROUP BY dataset, stage
  UNION ALL SELECT 'all_combined', stage, avg(cosine) FROM c WHERE has_ref AND has_hyp GROUP BY stage)
SELECT dataset, 1.0 AS T0, """ + ", ".join(
    S.rnd(f"any_value(score) FILTER (WHERE stage = '{s}')") + f" AS {s}" for s in LATER_STAGES) +
    " FROM g GROUP BY dataset")
def m8_mean_embedding_cosine(spark, sf):
    m = sm.mean_embedding_cosine_by_stage(fx.embedding_pairs(spark, sf))
    return _rnd_all(m, LATER_STAGES)


_TOK = """WITH tv AS (SELECT CAST(vec_id // 16 AS BIGINT) AS text_id, vec_id AS pos,
                  CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ids AS (SELECT DISTINCT text_id FROM tv),
pairs AS (SELECT text_id AS ref_id, text_id + 1 AS hyp_id,
            'T' || CAST(text_id % 3 + 1 AS VARCHAR) AS stage FROM ids
          WHERE text_id + 1 IN (SELECT text_id FROM ids)),
sim AS (SELECT p.ref_id, p.hyp_id, p.stage, r.pos AS rpos, h.pos AS hpos,
          list_dot_product(r.v, h.v) / (sqrt(list_dot_product(r.v, r.v)) * sqrt(list_dot_product(h.v, h.v))) AS s
        FROM pairs p JOIN tv r ON r.text_id = p.ref_id JOIN tv h ON h.text_id = p.hyp_id),
rec AS (SELECT ref_id, hyp_id, stage, avg(m) AS recall FROM (
          SELECT ref_id, hyp_id, stage, rpos, max(s) AS m FROM sim GROUP BY ALL) GROUP BY ALL),
prc AS (SELECT ref_id, hyp_id, stage, avg(m) AS precision FROM (
          SELECT ref_id, hyp_id, stage, hpos, max(s) AS m FROM sim GROUP BY ALL) GROUP BY ALL),
mt AS (SELECT rec.ref_id, rec.hyp_id, rec.stage, precision, recall,
         CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
       FROM rec JOIN prc ON rec.ref_id = prc.ref_id AND rec.hyp_id = prc.hyp_id)
"""


def _matched(spark, sf):
    return sm.greedy_match_f1(fx.token_vectors(spark, sf), fx.token_vector_pairs(spark, sf))


@register("m9_greedy_match_f1", _TOK + "SELECT ref_id, hyp_id, stage, " + ", ".join(
    S.rnd(c) + f" AS {c}" for c in ("precision", "recall", "f1")) + " FROM mt")
def m9_greedy_match_f1(spark, sf):
    return _rnd_all(_matched(spark, sf), ["precision", "recall", "f1"])


@register("m10_mean_match_by_stage", _TOK + "SELECT stage, 'BERTSCORE-F1' AS metric, " +
          S.rnd("avg(f1)") + " AS score FROM mt GROUP BY stage")
def m10_mean_match_by_stage(spark, sf):
    return _rnd_all(sm.mean_match_by_stage(_matched(spark, sf)), ["score"])


# ---------------------------------------------------------------------------------------------
# L: learning and evaluation
# ---------------------------------------------------------------------------------------------

_TFIDF_TOK = S.tokens("lower(coalesce(text, ''))", le.TFIDF_TOKEN_RE)


@register("l1_tfidf_vocabulary", f"""
WITH t AS (SELECT doc_id, {_TFIDF_TOK} AS tok FROM documents),
g AS (SELECT doc_id, unnest(tok || {S.bigrams('tok')}) AS term FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2
       ORDER BY cf DESC, term LIMIT 5000),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents)
SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, CAST(cf AS BIGINT) AS cf,
  {S.rnd('ln((1.0 + n.n) / (1.0 + df)) + 1.0')} AS idf FROM st, n""")
def l1_tfidf_vocabulary(spark, sf):
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "text")
    v = le.fit_vocabulary(docs, "doc_id", "text", max_features=5000, min_df=2)
    return v.select("term", F.col("idx").cast("long").alias("idx"), "df",
                    F.col("cf").cast("long").alias("cf"), rnd("idf").alias("idf"))


@register("l1_tfidf_weights", f"""
WITH t AS (SELECT doc_id, {_TFIDF_TOK} AS tok FROM documents),
g AS (SELECT doc_id, unnest(tok || {S.bigrams('tok')}) AS term FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2
       ORDER BY cf DESC, term LIMIT 5000),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
w AS (SELECT doc_id, term, (1.0 + ln(tf)) * (ln((1.0 + n.n) / (1.0 + df)) + 1.0) AS w
      FROM tf JOIN st USING (term), n)
SELECT doc_id, term, {S.rnd('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w""")
def l1_tfidf_weights(spark, sf):
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "text")
    v = stored(le.fit_vocabulary(docs, "doc_id", "text", max_features=5000, min_df=2), "vocabulary")
    return le.tfidf_weights(docs, v, "doc_id", "text").select("doc_id", "term", rnd("weight").alias("weight"))


@register("l2_holdout_split", S.F1_CHAINS.rstrip() + """,
h AS (SELECT *, CASE WHEN ('0x' || left(md5('42|{"dataset":"' || dataset || '","key":"' || key || '"}'), 8))::BIGINT
                          % 100 < 25 THEN 'test' ELSE 'train' END AS split FROM chains)
SELECT dataset, key, source, paraphraser, split FROM h""")
def l2_holdout_split(spark, sf):
    return le.holdout_split(chains(spark, sf)).select(*CH, "split")


@register("l2_holdout_attribution")
def l2_holdout_attribution(spark, sf):
    """Metrics of the held-out documents by stage (Q16: no document on both sides)."""
    model, vocab, held = le.train_attribution(chains(spark, sf), holdout_by=("dataset", "key"), one_row_each=True,
                                              fit_chains=rs.chains_with(long_versions(spark, sf), ["T0"]))
    return le.binary_metrics(le.predict_stages(model, vocab, held, one_row_each=True))


def _f4(spark, sf) -> DataFrame:
    """fixed prediction table over chain x stage rows (no model): (row_id, dataset, family,
    paraphraser, stage, present, label, prediction)."""
    ch = rs.chain_stages(long_versions(spark, sf))
    arr = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).isNotNull().alias("present"))
                    for s in STAGES])
    x = ch.select(F.concat_ws("|", *CH).alias("row_id"), *CH, "family",
                  tx.source_group("source").alias("label"), F.inline(arr))
    digit = F.substring(F.md5(F.concat_ws("#", "row_id", "stage")), 1, 1)
    thr = F.create_map(*[F.lit(v) for kv in fx.F4_FLIP_BELOW.items() for v in kv])[F.col("stage")]
    flip = digit < thr
    other = F.when(F.col("label") == "Human", "AI").otherwise("Human")
    return x.withColumn("prediction", F.when(flip, other).otherwise(F.col("label")))


_F4_SQL = S.F1_CHAINS.rstrip() + """,
x AS (SELECT concat_ws('|', dataset, key, source, paraphraser) AS row_id, dataset, key, source,
        paraphraser, family, CASE WHEN source = 'Human' THEN 'Human' ELSE 'AI' END AS label,
        s.stage, CASE s.stage WHEN 'T0' THEN T0 IS NOT NULL WHEN 'T1' THEN T1 IS NOT NULL
          WHEN 'T2' THEN T2 IS NOT NULL ELSE T3 IS NOT NULL END AS present
      FROM chains, (VALUES ('T0'), ('T1'), ('T2'), ('T3')) s(stage)),
f4 AS (SELECT *, CASE WHEN left(md5(row_id || '#' || stage), 1) < (CASE stage """ + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fx.F4_FLIP_BELOW.items()) + """ END)
        THEN (CASE WHEN label = 'Human' THEN 'AI' ELSE 'Human' END) ELSE label END AS prediction FROM x)
"""

_BIN_COLS = ["accuracy", "f1_macro", "f1_weighted", "human_precision", "human_recall",
             "ai_precision", "ai_recall"]


def _bin_sql(src: str, by: str, where: str = "present") -> str:
    def sd(a, b):
        return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"
    hp, hr = sd("tp", "tp + fp"), sd("tp", "tp + fn")
    ap, ar = sd("tn", "tn + fn"), sd("tn", "tn + fp")
    hf, af = sd(f"2 * {hp} * {hr}", f"{hp} + {hr}"), sd(f"2 * {ap} * {ar}", f"{ap} + {ar}")
    exprs = {"accuracy": sd("tp + tn", "n"), "f1_macro": f"(({hf}) + ({af})) / ((tp + fn + fp > 0)::INT + (tn + fp + fn > 0)::INT)",
             "f1_weighted": sd(f"({hf}) * (tp + fn) + ({af}) * (tn + fp)", "n"),
             "human_precision": hp, "human_recall": hr, "ai_precision": ap, "ai_recall": ar}
    return f"""conf AS (SELECT {by}, count(*) AS n,
    count(*) FILTER (WHERE label = 'Human' AND prediction = 'Human') AS tp,
    count(*) FILTER (WHERE label = 'AI' AND prediction = 'Human') AS fp,
    count(*) FILTER (WHERE label = 'Human' AND prediction = 'AI') AS fn,
    count(*) FILTER (WHERE label = 'AI' AND prediction = 'AI') AS tn
  FROM {src} WHERE {where} GROUP BY {by}),
bm AS (SELECT {by}, n, {', '.join(f'{e} AS {k}' for k, e in exprs.items())} FROM conf)
"""


@register("l3_evaluate_by_stage", _F4_SQL.rstrip() + ",\n" + _bin_sql("f4", "stage") +
          "SELECT stage, n, " + ", ".join(S.rnd(c) + f" AS {c}" for c in _BIN_COLS) + " FROM bm")
def l3_evaluate_by_stage(spark, sf):
    return _rnd_all(le.binary_metrics(_f4(spark, sf)), _BIN_COLS)


@register("l4_metrics_by_family", _F4_SQL.rstrip() + ",\n" +
          _bin_sql("f4", "family, stage", "present AND family <> 'none'") +
          "SELECT family, stage, n, " + ", ".join(S.rnd(c) + f" AS {c}" for c in _BIN_COLS) +
          " FROM bm WHERE family IN (SELECT family FROM chains GROUP BY family HAVING count(*) >= 10)")
def l4_metrics_by_family(spark, sf):
    return _rnd_all(le.metrics_by_family(_f4(spark, sf)), _BIN_COLS)


@register("l5_error_direction", _F4_SQL + """
SELECT stage, count(*) FILTER (WHERE label = 'Human' AND prediction = 'AI') AS human_misclassified_as_ai,
  """ + S.rnd("CASE WHEN count(*) FILTER (WHERE label = 'Human') > 0 THEN count(*) FILTER (WHERE label = 'Human' AND prediction = 'AI') / count(*) FILTER (WHERE label = 'Human') ELSE 0.0 END") + """ AS human_misclass_rate,
  count(*) FILTER (WHERE label = 'AI' AND prediction = 'Human') AS ai_misclassified_as_human,
  """ + S.rnd("CASE WHEN count(*) FILTER (WHERE label = 'AI') > 0 THEN count(*) FILTER (WHERE label = 'AI' AND prediction = 'Human') / count(*) FILTER (WHERE label = 'AI') ELSE 0.0 END") + """ AS ai_misclass_rate
FROM f4 GROUP BY stage""")
def l5_error_direction(spark, sf):
    return _rnd_all(le.error_direction_by_stage(_f4(spark, sf)),
                   ["human_misclass_rate", "ai_misclass_rate"])


@register("l6_error_by_domain", _F4_SQL + "SELECT dataset, count(*) AS n_samples, " +
          S.rnd("avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)") + " AS accuracy, " +
          S.rnd("1 - avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)") +
          " AS error_rate FROM f4 WHERE stage = 'T3' GROUP BY dataset")
def l6_error_by_domain(spark, sf):
    return _rnd_all(le.error_by_domain(_f4(spark, sf)), ["accuracy", "error_rate"])


@register("l6_error_by_family", _F4_SQL + "SELECT family, " +
          S.rnd("avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)") +
          " AS accuracy, count(*) AS n FROM f4 WHERE stage = 'T3' AND family <> 'none' GROUP BY family")
def l6_error_by_family(spark, sf):
    return _rnd_all(le.error_by_family(_f4(spark, sf)), ["accuracy"])


@register("l7_point_of_no_return", _F4_SQL.rstrip() + ",\n" + _bin_sql("f4", "stage") +
          "SELECT min(stage) FILTER (WHERE stage <> 'T0' AND accuracy <= 0.55) AS point_of_no_return "
          "FROM bm")
def l7_point_of_no_return(spark, sf):
    return le.point_of_no_return(le.binary_metrics(_f4(spark, sf)))


_FAMS = ["chatgpt", "dipper", "palm", "pegasus"]


def _f4_multi(spark, sf) -> DataFrame:
    """Fixed 4-class prediction table: T1 chains, label = family, wrong (next family) when the
    first md5 hex digit of the row is below the fixed digit."""
    ch = rs.chain_stages(long_versions(spark, sf)).where(F.col("T1").isNotNull())
    rid = F.concat_ws("|", *CH)
    nxt = F.create_map(*[F.lit(v) for i, f in enumerate(_FAMS)
                         for v in (f, _FAMS[(i + 1) % len(_FAMS)])])
    wrong = F.substring(F.md5(rid), 1, 1) < fx.F4_FAMILY_FLIP_BELOW
    return ch.select(rid.alias("row_id"), F.col("family").alias("label"),
                     F.when(wrong, nxt[F.col("family")]).otherwise(F.col("family"))
                     .alias("prediction"))


_F4M_SQL = S.F1_CHAINS.rstrip() + """,
fm AS (SELECT concat_ws('|', dataset, key, source, paraphraser) AS row_id, family AS label,
         CASE WHEN left(md5(concat_ws('|', dataset, key, source, paraphraser)), 1) < '""" + \
    fx.F4_FAMILY_FLIP_BELOW + "' THEN (CASE family " + " ".join(
        f"WHEN '{f}' THEN '{_FAMS[(i + 1) % len(_FAMS)]}'" for i, f in enumerate(_FAMS)) + \
    """ END) ELSE family END AS prediction FROM chains WHERE T1 IS NOT NULL)
"""


@register("l10_evaluate_fingerprint", _F4M_SQL.rstrip() + """,
cls AS (SELECT label AS cls FROM fm UNION SELECT prediction FROM fm),
lab AS (SELECT label AS cls, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS tp
        FROM fm GROUP BY label),
prd AS (SELECT prediction AS cls, count(*) AS predicted FROM fm GROUP BY prediction),
per AS (SELECT cls.cls, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
          coalesce(predicted, 0) AS predicted FROM cls LEFT JOIN lab USING (cls) LEFT JOIN prd USING (cls)),
m AS (SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support, tp FROM per),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
        ELSE 0.0 END AS f1 FROM m)
SELECT cls, """ + ", ".join(S.rnd(c) + f" AS {c}" for c in ("precision", "recall", "f1")) + """,
  CAST(support AS BIGINT) AS support, """ + S.rnd("sum(tp) OVER () / sum(support) OVER ()") +
    " AS accuracy, " + S.rnd("avg(f1) OVER ()") + " AS f1_macro FROM m2")
def l10_evaluate_fingerprint(spark, sf):
    m = le.multiclass_metrics(_f4_multi(spark, sf))
    return _rnd_all(m, ["precision", "recall", "f1", "accuracy", "f1_macro"])


@register("l10_confusion_matrix", _F4M_SQL.rstrip() + """,
cls AS (SELECT label AS c FROM fm UNION SELECT prediction FROM fm),
cnt AS (SELECT label, prediction, count(*) AS n FROM fm GROUP BY ALL)
SELECT l.label, c.c AS prediction, coalesce(cnt.n, 0) AS n
FROM (SELECT DISTINCT label FROM fm) l, cls c
LEFT JOIN cnt ON cnt.label = l.label AND cnt.prediction = c.c""")
def l10_confusion_matrix(spark, sf):
    return le.confusion_matrix(_f4_multi(spark, sf))


# model-based queries: rows-only checks (trained models are compared by thresholds in tests)

def _attribution(spark, sf, stages=STAGES):
    """L2 and its balanced chains, with the texts of ``stages``."""
    ch, t0 = (rs.chains_with(long_versions(spark, sf), x) for x in (stages, ["T0"]))
    return le.train_attribution(ch, seed=42, max_features=5000, min_df=2, one_row_each=True, fit_chains=t0)


@register("l2_train_attribution")
def l2_train_attribution(spark, sf):
    model, vocab, rows = _attribution(spark, sf, ["T0"])
    s = model.summary
    return spark.createDataFrame(
        [(int(rows.where("T0 is not null").count()), float(s.accuracy), int(vocab.count()))],
        "n_train long, train_accuracy double, vocabulary long")


@register("l3_evaluate_model_by_stage")
def l3_evaluate_model_by_stage(spark, sf):
    model, vocab, rows = _attribution(spark, sf)
    return le.binary_metrics(le.predict_stages(model, vocab, rows, one_row_each=True))


def _fingerprint_data(spark, sf, tfidf_features: int = 500, fit_on: str = "train"):
    """Vectors of T1 texts, balanced and split by family; the classes are the families that have
    T1 texts. ``fit_on='all'`` fits the vocabulary on both sides, as the reference does."""
    feats = _features(spark, sf)
    fc = sy.feature_chains(feats)
    t1 = fc.where(F.col("f_T1").isNotNull())
    row_id = F.to_json(F.struct(*CH), {"ignoreNullFields": "false"}).alias("row_id")
    # several actions follow (balance, split, vocabulary fit, sizes, training): the small rows are stored, no text is
    t1 = stored(t1.select(row_id, *CH, "family", *[F.col(f"f_T1.{c}").alias(c) for c in SCALAR_FEATURES + POS16]), "style")
    bal = rs.balance_classes(t1, "family", CH, seed=42)
    base = stored(rs.stratified_split(bal, "family", CH, 0.25, seed=42), "fingerprint")
    # the texts of the same rows, told by their keys
    balanced = rs.head_condition(t1, "family", CH, lambda total, mn: mn, seed=42)
    texts = rs.chains_with(long_versions(spark, sf), ["T1"]).where(balanced)
    fitted, n_docs = texts, base.count()
    if fit_on != "all":
        tested = rs.head_condition(base, "family", CH, lambda total, mn: F.ceil(total * F.lit(0.25)), seed=42)
        fitted, n_docs = texts.where(~tested), base.where(F.col("split") == "train").count()
    texts, fitted = (x.select(row_id, F.col("T1").alias("text")) for x in (texts, fitted))
    vocab = stored(le.fit_vocabulary(fitted, "row_id", "text", max_features=tfidf_features, min_df=1, one_row_each=True,
                                     n_docs=n_docs), "vocabulary")
    style = base.select("row_id", "family", "split", *SCALAR_FEATURES, *POS16)
    x = le.fingerprint_features(texts, style, "row_id", "text", vocab, SCALAR_FEATURES + POS16, one_row_each=True)
    families = le.class_names(base, "family")
    x = x.withColumn("label_idx", F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")
                                                   ).cast("double") - 1)
    names = SCALAR_FEATURES + POS16 + [r["term"] for r in vocab.orderBy("idx").collect()]
    return x, names, families


@register("l8_fingerprint_features")
def l8_fingerprint_features(spark, sf):
    x, names, _ = _fingerprint_data(spark, sf)
    return x.groupBy("family", "split").agg(F.count(F.lit(1)).alias("n"),
                                            F.lit(len(names)).alias("n_features"))


def _fingerprint_model(spark, sf):
    x, names, families = _fingerprint_data(spark, sf)
    model = le.train_fingerprint(x.where(F.col("split") == "train"))
    return model, x, names, families


@register("l9_train_fingerprint")
def l9_train_fingerprint(spark, sf):
    model, x, _, families = _fingerprint_model(spark, sf)
    named = F.element_at(F.array(*[F.lit(f) for f in families]), F.col("prediction").cast("int") + 1)
    pred = model.transform(x.where(F.col("split") == "test")) \
        .select(F.col("family").alias("label"), named.alias("prediction"))
    return le.multiclass_metrics(pred)


@register("l11_feature_importance")
def l11_feature_importance(spark, sf):
    model, _, names, _ = _fingerprint_model(spark, sf)
    return le.feature_importance(model, names, 20, spark)


def _pca_rows(spark, sf):
    ch = chains(spark, sf)
    row_id = F.to_json(F.struct(*CH, "stage"), {"ignoreNullFields": "false"})
    long = stored(rs.melt_chains(ch, ids=CH + ["family"]).withColumn("row_id", row_id), "stages")
    vocab = stored(le.fit_vocabulary(long, "row_id", "text", max_features=3000, min_df=1, one_row_each=True),
                   "vocabulary")
    x = le.transform_tfidf(long.select("row_id", "stage", "text"), vocab, "row_id", "text", one_row_each=True)
    return le.pca_explained(x, k=50)


@register("l12_pca")
def l12_pca(spark, sf):
    _, ev = _pca_rows(spark, sf)
    return spark.createDataFrame([(50, ev)], "k long, explained_variance double")


@register("l13_silhouette_by_stage")
def l13_silhouette_by_stage(spark, sf):
    proj, _ = _pca_rows(spark, sf)
    return spark.createDataFrame([(le.silhouette_by_stage(proj),)], "silhouette double")


# ---------------------------------------------------------------------------------------------
# A: audit
# ---------------------------------------------------------------------------------------------

def _content_and_wording(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The rows of E6 and the wide rows of M1, from one pass over the chains; only their numbers are stored."""
    ner = _ner_chains(spark, sf)
    ner = ner.withColumns({f"ret_{s}": en.retention(F.col("ner_T0"), F.col(f"ner_{s}")) for s in LATER_STAGES})
    both = stored(sm.score_chains(ner, ["bleu"], keep=[f"ret_{s}" for s in LATER_STAGES]), "audit")
    ret = both.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"ret_{s}").alias("m"))
                                         for s in LATER_STAGES]))).select("stage", "m.*")
    content = _rnd_all(en.retention_summary(ret), list(DBL) + ["mean_t0_entities", "mean_tn_entities"])
    return content, _rnd_all(both.drop(*[f"ret_{s}" for s in LATER_STAGES]), [f"bleu_{s}" for s in LATER_STAGES])


def _audit(spark, sf) -> DataFrame:
    """A1 over the reported layer tables (the same rounded tables the layer queries return)."""
    structure = y10_mean_pos_cosine_by_stage(spark, sf).select(
        "stage", F.col("pos_cosine").alias("value"))
    match = m10_mean_match_by_stage(spark, sf).select("stage", F.col("score").alias("value"))
    emb = m8_mean_embedding_cosine(spark, sf).where(F.col("dataset") == "all_combined") \
        .unpivot([], LATER_STAGES, "stage", "value")
    content, wording = _content_and_wording(spark, sf)
    content = content.select("stage", F.col("jaccard").alias("value"))
    lex = wording.agg(*[F.avg(f"bleu_{s}").alias(s) for s in LATER_STAGES]) \
        .unpivot([], LATER_STAGES, "stage", "value")
    return au.multi_layer_audit({"structure": structure, "semantics_match": match,
                                 "semantics_embedding": emb, "content": content, "lexical": lex})


def _audit_sql() -> str:
    y10 = QUERIES_SQL("y10_mean_pos_cosine_by_stage")
    m10 = QUERIES_SQL("m10_mean_match_by_stage")
    m8 = QUERIES_SQL("m8_mean_embedding_cosine")
    e6 = QUERIES_SQL("e6_retention_summary")
    m1 = QUERIES_SQL("m1_bleu2")
    return f"""WITH lay AS (
  SELECT 'structure' AS layer, stage, pos_cosine AS value FROM ({y10})
  UNION ALL SELECT 'semantics_match', stage, score FROM ({m10})
  UNION ALL SELECT 'semantics_embedding', 'T1', T1 FROM ({m8}) WHERE dataset = 'all_combined'
  UNION ALL SELECT 'semantics_embedding', 'T2', T2 FROM ({m8}) WHERE dataset = 'all_combined'
  UNION ALL SELECT 'semantics_embedding', 'T3', T3 FROM ({m8}) WHERE dataset = 'all_combined'
  UNION ALL SELECT 'content', stage, jaccard FROM ({e6})
  UNION ALL SELECT 'lexical', 'T1', avg(bleu_T1) FROM ({m1})
  UNION ALL SELECT 'lexical', 'T2', avg(bleu_T2) FROM ({m1})
  UNION ALL SELECT 'lexical', 'T3', avg(bleu_T3) FROM ({m1})),
au AS (SELECT layer, 1.0 AS T0, """ + ", ".join(
        f"any_value(value) FILTER (WHERE stage = '{s}') AS {s}" for s in LATER_STAGES) + \
        " FROM lay GROUP BY layer)\n"


def QUERIES_SQL(name: str) -> str:
    from textdrift.plans.catalog import ORACLE
    return ORACLE[name]


_AUD = _audit_sql()


@register("a1_multi_layer_audit", _AUD + "SELECT layer, T0, " + ", ".join(
    S.rnd(s) + f" AS {s}" for s in LATER_STAGES) + " FROM au")
def a1_multi_layer_audit(spark, sf):
    return _rnd_all(_audit(spark, sf), LATER_STAGES)


@register("a2_audit_t3", _AUD + "SELECT layer, " + S.rnd("T3") + " AS t3, " + S.rnd("T3 - 1.0") +
          " AS decay FROM au")
def a2_audit_t3(spark, sf):
    return _rnd_all(au.audit_t3(_audit(spark, sf)), ["t3", "decay"])


@register("a3_decay_hierarchy", _AUD + "SELECT layer, " + S.rnd("T3") +
          " AS T3, rank() OVER (ORDER BY T3 ASC NULLS LAST, layer) AS rank FROM au")
def a3_decay_hierarchy(spark, sf):
    return _rnd_all(au.decay_hierarchy(_audit(spark, sf)), ["T3"]) \
        .withColumn("rank", F.col("rank").cast("long"))

"""DuckDB-dialect SQL for the oracle: fixture CTEs and shared expressions.

These strings are the independent second implementation that the driver runs next to the
Spark queries. Regexes are the same fixed strings as on the Spark side (explicit classes that
mean the same in Java and RE2). Doubles are rounded through DECIMAL, which rounds the decimal
value like Spark's ``round``/``bround`` do.
"""

from __future__ import annotations

from textdrift.constants import FAMILIES, STOPWORDS_EN
from textdrift.functions import text as tx
from textdrift.operators import entities as en
from textdrift.operators import style as sy
from textdrift.sources.fixtures import (F1_DATASETS, F1_MISSING_T2_EVERY, F1_REWRITERS,
                                        F2_REWRITERS)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _dec(x: str) -> str:
    # the shortest decimal string of the double, like Java's Double.toString used by Spark
    return f"CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18))"


def rnd(x: str) -> str:
    """Spark ``round(x, 9)`` (HALF_UP on the decimal string)."""
    return f"CAST(round({_dec(x)}, 9) AS DOUBLE)"


def r4e(x: str) -> str:
    """Spark ``bround(x, 4)`` (HALF_EVEN on the decimal string)."""
    return f"CAST(round_even({_dec(x)}, 4) AS DOUBLE)"


def case_mod(col: str, n: int, labels) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(l)}" for i, l in enumerate(labels))
    return f"CASE {col} % {n} {whens} END"


def family_of(p: str) -> str:
    parts = [f"WHEN {p} = 'original' THEN 'none'"]
    for fam, members in FAMILIES.items():
        parts.append(f"WHEN {p} IN ({', '.join(q(m) for m in members)}) THEN {q(fam)}")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


def stage_of(v: str) -> str:
    us = f"(length({v}) - length(replace({v}, '_', '')))"
    return (f"CASE WHEN {v} = 'original' THEN 'T0' WHEN {us} = 0 THEN 'T1' "
            f"WHEN {us} = 1 THEN 'T2' WHEN {us} > 1 THEN 'T3' END")


def tokens(col: str, pattern: str) -> str:
    return f"regexp_extract_all({col}, {q(pattern)})"


def bleu_tokens(col: str) -> str:
    return f"coalesce({tokens(f'lower({col})', tx.BLEU_TOKEN_RE)}, [])"


def rouge_tokens(col: str) -> str:
    return f"coalesce({tokens(f'lower({col})', tx.ROUGE_TOKEN_RE)}, [])"


def bigrams(lst: str) -> str:
    return f"list_transform(range(1, len({lst})), lambda i: {lst}[i] || ' ' || {lst}[i + 1])"


def word_count(col: str) -> str:
    return f"len({tokens(col, tx.WORD_RE)})"


def clean_text(col: str) -> str:
    return ("trim(regexp_replace(regexp_replace(lower(" + col + "), '[^a-z0-9 ]', '', 'g'), "
            "' +', ' ', 'g'))")


def remove_stopwords(col: str) -> str:
    words = ", ".join(q(w) for w in STOPWORDS_EN)
    return (f"array_to_string(list_filter(string_split({col}, ' '), "
            f"lambda x: NOT list_contains([{words}], x)), ' ')")


def blank(col: str) -> str:
    return f"({col} IS NULL OR NOT regexp_matches({col}, {q(tx.WORD_RE)}))"


def guard(col: str) -> str:
    return f"CASE WHEN {blank(col)} THEN '' ELSE {col} END"


# ---------------------------------------------------------------------------------------------
# fixture CTEs
# ---------------------------------------------------------------------------------------------

def versions_cte(name: str = "versions") -> str:
    steps = ", ".join(["('original', 1, 0)"] + [f"({q(p)}, {m}, {n})" for p, m in F1_REWRITERS
                                                 for n in (1, 2, 3)])
    return f"""{name} AS (
  SELECT dataset, source, concat(dataset, '-', CAST(doc_id AS VARCHAR)) AS key,
    CASE WHEN n = 0 THEN text
         ELSE array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % m >= n), ' ')
    END AS text,
    CASE WHEN n = 0 THEN 'original' WHEN n = 1 THEN p WHEN n = 2 THEN concat(p, '_', p)
         ELSE concat(p, '_', p, '_', p) END AS version_name,
    CAST(n AS BIGINT) AS seq
  FROM (SELECT doc_id, text, {case_mod('doc_id', 7, F1_DATASETS)} AS dataset,
               CASE WHEN doc_id % 3 = 0 THEN 'Human' ELSE 'OpenAI' END AS source
        FROM documents) d, (VALUES {steps}) r(p, m, n)
  WHERE NOT (doc_id % {F1_MISSING_T2_EVERY} = 0 AND n = 2))"""


def turn_versions_cte(name: str = "versions") -> str:
    return f"""{name} AS (
  SELECT 'conv' AS dataset, role AS source, concat('conv-', CAST(conv_id AS VARCHAR)) AS key, text,
    CASE k WHEN 1 THEN 'original' WHEN 2 THEN p WHEN 3 THEN concat(p, '_', p)
           ELSE concat(p, '_', p, '_', p) END AS version_name, CAST(turn AS BIGINT) AS seq
  FROM (SELECT conv_id, role, turn, text,
               row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k,
               {case_mod('conv_id', 7, F2_REWRITERS)} AS p
        FROM conversations) r)"""


def long_cte(src: str = "versions", name: str = "lv") -> str:
    return f"""{name} AS (
  SELECT *, {stage_of('version_name')} AS stage, split_part(version_name, '_', 1) AS paraphraser,
         {family_of("split_part(version_name, '_', 1)")} AS family
  FROM {src})"""


def chains_cte(src: str = "lv", name: str = "chains", values=()) -> str:
    """R1 in SQL: T0 per document joined to per-rewriter stage texts (and extra value columns)."""
    extra_t0 = "".join(f", arg_min({v}, seq) AS {v}_T0" for v in values)
    extra = "".join(f", arg_min({v}, seq) FILTER (WHERE stage = '{s}') AS {v}_{s}"
                    for v in values for s in ("T1", "T2", "T3"))
    extra_sel = "".join(f", t0.{v}_T0" + "".join(f", pc.{v}_{s}" for s in ("T1", "T2", "T3"))
                        for v in values)
    return f"""{name}_t0 AS (
  SELECT dataset, key, source, arg_min(text, seq) AS T0{extra_t0}
  FROM {src} WHERE stage = 'T0' GROUP BY dataset, key, source),
{name}_pc AS (
  SELECT dataset, key, source, paraphraser,
    arg_min(text, seq) FILTER (WHERE stage = 'T1') AS T1,
    arg_min(text, seq) FILTER (WHERE stage = 'T2') AS T2,
    arg_min(text, seq) FILTER (WHERE stage = 'T3') AS T3{extra}
  FROM {src} WHERE paraphraser <> 'original' GROUP BY dataset, key, source, paraphraser),
{name} AS (
  SELECT pc.dataset, pc.key, pc.source, pc.paraphraser, {family_of('pc.paraphraser')} AS family,
         t0.T0, pc.T1, pc.T2, pc.T3{extra_sel}
  FROM {name}_pc pc LEFT JOIN {name}_t0 t0
    ON pc.dataset = t0.dataset AND pc.key = t0.key AND pc.source = t0.source)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


F1_CHAINS = with_(versions_cte(), long_cte(), chains_cte())
F2_CHAINS = with_(turn_versions_cte(), long_cte(), chains_cte())


# ---------------------------------------------------------------------------------------------
# entity and style expressions
# ---------------------------------------------------------------------------------------------

def entity_set(col: str) -> str:
    return (f"list_distinct(list_transform({tokens(guard(col), en.MENTION_RE)}, "
            f"lambda m: lower(trim(m))))")


def mention_label(m: str) -> str:
    return (f"CASE WHEN regexp_matches({m}, '^https?://') THEN 'URL' "
            f"WHEN contains({m}, '@') THEN 'EMAIL' "
            f"WHEN regexp_matches({m}, {q(r'^\p{N}')}) THEN 'NUMBER' ELSE 'NAME' END")


def sorted_join(lst: str) -> str:
    return f"array_to_string(list_sort({lst}), '|')"


def retention_exprs(ref: str, hyp: str) -> dict:
    nr, nh = f"len({ref})", f"len({hyp})"
    sh = f"len(list_intersect({ref}, {hyp}))"
    un = f"len(list_distinct({ref} || {hyp}))"
    both = f"({nr} = 0 AND {nh} = 0)"
    return {
        "jaccard": f"CASE WHEN {both} THEN 1.0 WHEN {nr} = 0 OR {nh} = 0 THEN 0.0 ELSE {sh} / {un} END",
        "recall": f"CASE WHEN {both} THEN 1.0 WHEN {nr} = 0 THEN NULL WHEN {nh} = 0 THEN 0.0 "
                  f"ELSE {sh} / {nr} END",
        "precision": f"CASE WHEN {both} THEN 1.0 WHEN {nr} = 0 THEN 0.0 WHEN {nh} = 0 THEN NULL "
                     f"ELSE {sh} / {nh} END",
        "n_ref": f"CAST({nr} AS BIGINT)",
        "n_hyp": f"CAST({nh} AS BIGINT)",
        "n_shared": f"CAST(CASE WHEN {nr} = 0 OR {nh} = 0 THEN 0 ELSE {sh} END AS BIGINT)",
    }


def lexicon_values() -> str:
    return ", ".join(f"({q(w)}, {q(t)})" for t, ws in sy.LEXICON.items() for w in ws)


def rule_tag(tok: str, lex: str) -> str:
    parts = [f"WHEN {lex} IS NOT NULL THEN {lex}",
             f"WHEN regexp_matches({tok}, {q(r'^\p{N}+$')}) THEN 'NUM'",
             f"WHEN regexp_matches({tok}, {q(r'^\p{P}$')}) THEN 'PUNCT'",
             f"WHEN regexp_matches({tok}, {q(r'^\p{S}$')}) THEN 'SYM'"]
    for tag, pat in sy.SUFFIX_RULES:
        parts.append(f"WHEN regexp_matches(lower({tok}), {q(pat)}) THEN {q(tag)}")
    return "CASE " + " ".join(parts) + " ELSE 'X' END"


def sentence_lengths(col: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({guard(col)}, "
            f"{q(tx.SENTENCE_SPLIT_RE)}), lambda s: len(list_filter({tokens('s', tx.WORD_RE)}, "
            f"lambda w: regexp_matches(w, {q(tx.HAS_ALNUM_RE)})))), "
            f"lambda n: n > 0)")


# population variance from (n, sum, sum of squares): exact integer numerator
SENT_VAR = ("CASE WHEN len({sl}) > 0 THEN CAST(len({sl}) * list_sum(list_transform({sl}, "
            "lambda x: CAST(x AS BIGINT) * x)) - list_sum({sl}) * list_sum({sl}) AS DOUBLE) / "
            "CAST(len({sl}) * len({sl}) AS DOUBLE) ELSE 0.0 END")


def text_feature_exprs(col: str) -> dict:
    """Y1-Y3 over a text column (expects a lateral ``sl`` alias for the sentence lengths)."""
    alpha = tokens(f"lower({guard(col)})", tx.ALPHA_RE)
    g = guard(col)
    return {
        "ttr": f"CASE WHEN len({alpha}) > 0 THEN len(list_distinct({alpha})) / len({alpha}) "
               f"ELSE 0.0 END",
        "punct_ratio": f"CASE WHEN length({g}) > 0 THEN (length({g}) - length(regexp_replace("
                       f"{g}, {q(tx.PUNCT_CLASS_RE)}, '', 'g'))) / length({g}) ELSE 0.0 END",
    }

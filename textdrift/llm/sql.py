"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from textdrift.llm import collocations, decontamination, hard_negatives, licenses, near_duplicates, rules, substrings


def rules_sql() -> str:
    """SQL of op7: words by unnesting, 8-word windows by lead()."""
    leads = ", ".join(f"lead(w, {i}) OVER p" for i in range(1, rules.WINDOW))
    stop = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
    tests = " AND ".join(
        f"coalesce({top} / nullif({bottom}::DOUBLE, 0), 0) BETWEEN {least!r}::DOUBLE AND {most!r}::DOUBLE"
        for _, top, bottom, least, most in rules.RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS i
          FROM (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS x FROM d)),
sums AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(DISTINCT w) AS n_distinct_words,
                count(*) FILTER (WHERE lower(w) IN ({stop})) AS n_stop_words FROM words GROUP BY r),
wins AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM
         (SELECT r, i, concat_ws(' ', w, {leads}) AS k, lead(w, {rules.WINDOW - 1}) OVER p AS last_w FROM words
          WINDOW p AS (PARTITION BY r ORDER BY i)) WHERE last_w IS NOT NULL),
reps AS (SELECT r, sum(least({rules.WINDOW}, coalesce(nxt - i, {rules.WINDOW}))) AS n_repeat_words
         FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM wins WHERE c > 1) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counts AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
                  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                  coalesce(n_stop_words, 0) AS n_stop_words,
                  coalesce(n_distinct_words, 0) * greatest(1.0::DOUBLE, coalesce(n_words, 0) / 500::DOUBLE)
                      AS n_distinct_scaled
           FROM d LEFT JOIN sums USING (r) LEFT JOIN reps USING (r) LEFT JOIN lines USING (r)),
judged AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words
                      AS base_failed, {tests} AS passed FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND passed AS kept FROM judged"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontamination_sql() -> str:
    """SQL of op2: every window of the items is looked up at every word of the documents."""
    size = decontamination.WINDOW
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all({_LOWER}, {word}) AS w
               FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), {size}) AS m, array_to_string(w[i:i + {size - 1}], ' ') AS k
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM items
               WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {word}) AS w FROM documents),
words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
lists AS (SELECT r, i, array_agg(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)
                 AS l FROM words),
found AS (SELECT DISTINCT r, i, m, item_id FROM
          (SELECT r, i, m, array_to_string(l[1:m], ' ') AS k FROM lists, (SELECT DISTINCT m FROM wins)
           WHERE len(l) >= m) JOIN wins USING (m, k)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN names USING (r)"""


def substrings_sql() -> str:
    """SQL of op4: windows as strings, counted over the corpus."""
    size = substrings.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
wins AS (SELECT r, i, string_agg(w, ' ') OVER p AS k, count(*) OVER p AS n FROM words
         WINDOW p AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),
starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM wins WHERE n = {size})
           WHERE c > 1),
cut AS (SELECT r, i, max(s) OVER (PARTITION BY r ORDER BY i) AS last_start
        FROM (SELECT words.r, words.i, starts.i AS s FROM words LEFT JOIN starts
              ON words.r = starts.r AND words.i = starts.i)),
kept AS (SELECT r, count(*) AS n_kept, string_agg(w, ' ' ORDER BY i) AS t FROM words JOIN cut USING (r, i)
         WHERE last_start IS NULL OR i >= last_start + {size} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def near_duplicates_sql(size: int = 4) -> str:
    """SQL of op10: all pairs that share a shingle, and their transitive closure."""
    part, whole = near_duplicates.THRESHOLD
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
                            regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
grams AS (SELECT DISTINCT r, k FROM (
          SELECT r, i, count(*) OVER p AS n, string_agg(w, ' ') OVER p AS k FROM words
          WINDOW p AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING))
          WHERE n = {size} OR i = 1),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
links AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM grams x JOIN grams y USING (k)
                            WHERE x.r <> y.r GROUP BY 1, 2)
          JOIN sizes s ON a = s.r JOIN sizes t ON b = t.r WHERE {whole} * c >= {part} * (s.n + t.n - c)),
reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.o = links.a),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
       doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN least USING (r) LEFT JOIN sizes USING (r)"""


def licenses_sql() -> str:
    """SQL of op3: exact containment in every window, without MinHash."""
    rows = ", ".join(
        f"('{name}', {licenses.window_shape(text)[0]}, {licenses.window_shape(text)[1]}, "
        f"{licenses.template_shingles(text)!r})" for name, text in licenses.TEMPLATES.items())
    n = licenses.SHINGLE
    return f"""
WITH templates(name, size, stride, known) AS (VALUES {rows}),
words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w
          FROM documents),
d AS (SELECT r, doc_id, list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) AS g
      FROM words),
found AS (SELECT r, name FROM
          (SELECT r, name, size, known, g, unnest(range(0, len(g), stride)) AS i
           FROM d JOIN templates ON list_has_any(g, known))
          WHERE 100 * len(list_intersect(g[i + 1:i + size - {n - 1}], known)) >= {licenses.CONTAINMENT} * len(known)),
sums AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT name) AS n_licenses,
                count(*) AS n_matches FROM found GROUP BY r)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_licenses, 0)::BIGINT AS n_licenses,
       coalesce(n_matches, 0)::BIGINT AS n_matches FROM d LEFT JOIN sums USING (r)"""


def collocations_sql() -> str:
    """SQL of op11: all phrases of two and three words counted, without a frontier."""
    least, top, contained = collocations.LEAST, collocations.TOP, collocations.CONTAINED
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT row_number() OVER () AS r, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT r, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lists),
runs AS (SELECT lang, w, lead(w, 1) OVER p AS x, lead(w, 2) OVER p AS y FROM words
         WINDOW p AS (PARTITION BY r ORDER BY i)),
f AS (SELECT lang, 1 AS m, w AS phrase, count(*) AS a FROM runs GROUP BY ALL
      UNION ALL SELECT lang, 2, w || ' ' || x, count(*) FROM runs WHERE x IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, 3, w || ' ' || x || ' ' || y, count(*) FROM runs WHERE y IS NOT NULL GROUP BY ALL),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {least}),
cuts AS (SELECT c.lang, c.m, c.phrase, c.a, k, x.a AS l, y.a AS r,
                1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS score
         FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, phrase, max(a) AS longer FROM (
         SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
         FROM cand WHERE m = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       score::BIGINT AS score
FROM best LEFT JOIN held USING (lang, phrase) JOIN sizes USING (lang)
WHERE m = 3 OR longer IS NULL OR 100 * longer < {contained} * a QUALIFY rank <= {top}"""


def hard_negatives_sql() -> str:
    """SQL of op12: every anchor against every row."""
    o = hard_negatives.Options()
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {o.shifted} = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
             list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {o.every} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {o.positives})
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {o.least} * positive_score <= 100 * score AND 100 * score <= {o.most} * positive_score
QUALIFY rank <= {o.negatives}"""

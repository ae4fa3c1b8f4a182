"""DuckDB SQL of the queries whose rules SQL can express, built from the operators' parameters."""

from __future__ import annotations

from .licences import TEMPLATES, bigrams, normalised
from .quality import ITERATIONS, RULES, SYMBOLS


def quality_sql() -> str:
    n = len(RULES)
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (_, good, bad) in enumerate(RULES))
    v = ", ".join(f"v{j}" for j in range(n))
    odds = " + ".join(["ln(prior / (1 - prior))", *(f"v{j} * ln(a{j} / (1 - a{j}))" for j in range(n))])
    right = ", ".join(
        f"CASE WHEN sum(n * abs(v{j})) = 0 THEN 0.8 ELSE least(0.99, greatest(0.55, sum(n * CASE v{j} WHEN 1 THEN p WHEN -1 THEN 1 - p ELSE 0 END) / sum(n * abs(v{j})))) END AS a{j}"
        for j in range(n)
    )
    gone = lambda chars: " + ".join(f"(length(text) - length(replace(text, '{c}', '')))" for c in chars)
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (
  SELECT row_no, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT row_no, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (
  SELECT row_no, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT row_no, unnest(range(i, i + 8)) AS q
        FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, s) AS c FROM win) WHERE c > 1)
  GROUP BY row_no),
f AS (
  SELECT w.row_no, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST({gone(SYMBOLS)} AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, {gone(map(chr, range(65, 91)))} AS n_capitals
  FROM w LEFT JOIN rep USING (row_no)),
votes AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {votes} FROM f),
pattern AS (SELECT {v}, count(*) AS n FROM votes GROUP BY ALL),
em AS (
  SELECT 0 AS it, CAST(0.5 AS DOUBLE) AS prior, {", ".join(f"CAST(0.8 AS DOUBLE) AS a{j}" for j in range(n))}
  UNION ALL
  SELECT it + 1, least(0.99, greatest(0.01, sum(n * p) / sum(n))), {right}
  FROM (SELECT it, pattern.*, 1 / (1 + exp(-({odds}))) AS p FROM em, pattern WHERE it < {ITERATIONS}) GROUP BY it)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS posterior
FROM (SELECT votes.*, 1 / (1 + exp(-({odds}))) AS p FROM votes, (SELECT * FROM em WHERE it = {ITERATIONS}))
"""


def licence_sql(least: float = 0.8) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = [(name, bigrams(normalised(t))) for name, texts in sorted(TEMPLATES.items()) for t in texts]
    rows = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, g))}])" for name, g in known)
    return rf"""
WITH t(licence, grams) AS (VALUES {rows}),
lines AS (SELECT doc_id, 'line' AS unit, string_split(text, chr(10)) AS u FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT doc_id, 'paragraph' AS unit, regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n') AS u FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unit, unnest(u) AS x, unnest(range(len(u))) AS unit_no FROM lines
  UNION ALL SELECT * FROM (SELECT doc_id, unit, unnest(u) AS x, unnest(range(len(u))) AS unit_no FROM blocks) WHERE contains(x, chr(10))),
words AS (
  SELECT row_number() OVER () AS row_no, doc_id, unit, unit_no,
         string_split(trim(regexp_replace(lower(x), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (
  SELECT * EXCLUDE (w), list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
dice AS (
  SELECT row_no, doc_id, unit, unit_no, licence, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams, t WHERE len(g) * (2 - {least}) >= len(grams) * {least} AND len(g) * {least} <= len(grams) * (2 - {least}))
SELECT doc_id, unit, CAST(unit_no AS BIGINT) AS unit_no, licence, round(dice, 6) AS dice FROM dice
WHERE dice >= {least} QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY dice DESC, licence) = 1
"""

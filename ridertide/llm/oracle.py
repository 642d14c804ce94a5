"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

CASCADE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words, string_split(text, chr(10)) AS lines FROM d),
f AS (
  SELECT doc_id, words, list_filter(lines, lambda x: regexp_matches(x, '{WORD}')) AS full_lines,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
u AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM f),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM u),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
p AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS place FROM r WHERE n > 1),
q AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (
  SELECT f.doc_id, len(words) AS n_words, word_chars, n_symbols,
    len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(full_lines) AS n_lines,
    len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
    len(list_filter(full_lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•)'))) AS n_bullets,
    len(list_filter(full_lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM f LEFT JOIN q ON f.doc_id = q.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 2 * word_chars >= 5 * n_words AND word_chars <= 12 * n_words AND 10 * n_symbols <= n_words
  AND 2 * n_dup_lines <= n_lines AND 100 * n_letter_words >= 80 * n_words
  AND 100 * n_bullets <= 90 * n_lines AND 100 * n_ellipses <= 30 * n_lines AS kept
FROM b
"""

LINES = """
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, text FROM documents),
lines AS (
  SELECT DISTINCT doc_id, host, trim(line) AS line
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM pages)),
counts AS (SELECT host, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY host, line),
hosts AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
boiler AS (
  SELECT c.host, list(c.line) AS boiler FROM counts c JOIN hosts h ON c.host = h.host
  WHERE n >= 5 AND n > 0.1 * pages GROUP BY c.host),
kept AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(boiler, []), trim(x))) AS kept
  FROM pages LEFT JOIN boiler ON pages.host = boiler.host)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
  sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM kept
"""

SKETCH = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM d),
t AS (SELECT doc_id, n AS n_chars, text, after, left(text, n - n // 2) || left(after, n // 2) AS edited FROM e),
texts AS (
  SELECT DISTINCT txt FROM (SELECT text AS txt FROM t UNION ALL SELECT edited FROM t)),
w AS (SELECT txt, list_filter(string_split_regex(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM texts),
h AS (
  SELECT txt, list_sort(list_distinct(CASE
    WHEN len(words) >= 5
      THEN list_transform(range(1, len(words) - 3), lambda i: left(md5(array_to_string(words[i:i + 4], ' ')), 16))
    WHEN len(words) > 0 THEN [left(md5(array_to_string(words, ' ')), 16)]
    ELSE [] END)) AS hashes FROM w),
s AS (
  SELECT txt, CASE WHEN len(list_filter(hashes, lambda x: x < '1000000000000000')) >= 16
    THEN list_filter(hashes, lambda x: x < '1000000000000000') ELSE hashes[1:16] END AS sketch FROM h),
c AS (
  SELECT txt, sketch, CASE WHEN len(sketch) < 16 THEN '~'
    ELSE greatest('1000000000000000', sketch[len(sketch)] || '~') END AS bound FROM s),
j AS (
  SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a.sketch, '') AS fingerprint,
    array_to_string(b.sketch, '') AS edited_fingerprint,
    list_filter(a.sketch, lambda x: x < least(a.bound, b.bound)) AS ab,
    list_filter(b.sketch, lambda x: x < least(a.bound, b.bound)) AS ba,
    list_filter(a.sketch, lambda x: x < least(a.bound, n.bound)) AS an,
    list_filter(n.sketch, lambda x: x < least(a.bound, n.bound)) AS na
  FROM t JOIN c a ON t.text = a.txt JOIN c b ON t.edited = b.txt JOIN c n ON t.after = n.txt)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(ab) + len(ba) = 0 THEN 1.0::DOUBLE
    ELSE len(list_intersect(ab, ba))::DOUBLE / len(list_distinct(list_concat(ab, ba))) END AS near_edited,
  CASE WHEN len(an) + len(na) = 0 THEN 1.0::DOUBLE
    ELSE len(list_intersect(an, na))::DOUBLE / len(list_distinct(list_concat(an, na))) END AS near_next,
  CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE
    ELSE len(list_intersect(ab, ba))::DOUBLE / len(ab) END AS contained_edited,
  CASE WHEN len(an) = 0 THEN 1.0::DOUBLE
    ELSE len(list_intersect(an, na))::DOUBLE / len(an) END AS contained_next
FROM j
"""

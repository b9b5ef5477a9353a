"""DuckDB SQL for the quality rules: the same measures and fences, from exact counts of buckets."""

ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols
  FROM t),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS s FROM t),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT s) AS n_dup_lines FROM line WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT w.r, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars, n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines
  FROM w LEFT JOIN lines USING (r)),
win AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
c AS (
  SELECT t.r, t.doc_id, t.lang, t.source, b.n_words, b.word_chars, b.n_symbols, b.n_lines, b.n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words
  FROM t JOIN base b USING (r) LEFT JOIN rep USING (r)),
m AS (
  SELECT r, lang, source, n_words, 'symbols' AS measure, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS v, n_words AS n FROM c
  UNION ALL SELECT r, lang, source, n_words, 'repeats', CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END, n_words FROM c
  UNION ALL SELECT r, lang, source, n_words, 'dup_lines', CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END, n_lines FROM c
  UNION ALL SELECT r, lang, source, n_words, 'word_length', CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END, n_words FROM c),
k AS (SELECT *, ((v >> greatest(len(bin(v)) - 5, 0)) << greatest(len(bin(v)) - 5, 0)) + (1::BIGINT << greatest(len(bin(v)) - 5, 0)) - 1 AS bucket FROM m WHERE n_words > 0),
own AS (
  SELECT lang, source, measure, count(*) AS total, quantile_disc(bucket, 0.25) AS lo, quantile_disc(bucket, 0.75) AS hi FROM k GROUP BY ALL),
by_lang AS (SELECT lang, measure, count(*) AS total, quantile_disc(bucket, 0.25) AS lo, quantile_disc(bucket, 0.75) AS hi FROM k GROUP BY ALL),
corpus AS (SELECT measure, quantile_disc(bucket, 0.25) AS lo, quantile_disc(bucket, 0.75) AS hi FROM k GROUP BY ALL),
wider AS (
  SELECT l.lang, l.measure, (l.total * (l.hi + 3.0::DOUBLE * (l.hi - l.lo)) + 10 * (g.hi + 3.0::DOUBLE * (g.hi - g.lo))) / (l.total + 10) AS f
  FROM by_lang l JOIN corpus g ON l.measure = g.measure),
fence AS (
  SELECT o.lang, o.source, o.measure, (o.total * (o.hi + 3.0::DOUBLE * (o.hi - o.lo)) + 10 * w.f) / (o.total + 10) AS f
  FROM own o JOIN wider w ON o.lang IS NOT DISTINCT FROM w.lang AND o.measure = w.measure),
over_ AS (
  SELECT r, bool_or(coalesce(v > f + 3.0::DOUBLE * (1000.0::DOUBLE / sqrt(greatest(n, 1)::DOUBLE)), false)) AS any_over
  FROM m LEFT JOIN fence ON m.lang IS NOT DISTINCT FROM fence.lang AND m.source IS NOT DISTINCT FROM fence.source AND m.measure = fence.measure GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT any_over AS kept
FROM c JOIN over_ USING (r)
"""

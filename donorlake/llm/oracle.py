"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from donorlake.llm import quality_rules, url_filter

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(" ".join(quality_rules.STOP_WORDS.values()).split())))
_PHRASES = ", ".join(f"'{rule.text}'" for rule in url_filter.PHRASES)

# ``words`` is a list, ``n`` its length; windows are joined by a blank, which no word holds.
OP9 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS n_letters,
         length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS n_upper,
         len(list_filter(words, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOPS}))) AS n_stops
  FROM d LEFT JOIN covered USING (doc_id)),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 AND word_chars / n_words BETWEEN 2.0 AND 14.0 THEN NULL ELSE 'mean_word_length' END AS r1,
         CASE WHEN n_words > 0 AND n_symbols / n_words > 0.2 THEN 'symbols_per_word' END AS r2,
         CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'duplicate_lines' END AS r3,
         CASE WHEN word_chars > 0 AND n_letters / word_chars >= 0.7 THEN NULL ELSE 'letters' END AS r4,
         CASE WHEN n_letters > 0 AND n_upper / n_letters > 0.5 THEN 'upper_case' END AS r5,
         CASE WHEN n_words > 0 AND n_stops / n_words >= 0.04 THEN NULL ELSE 'stop_words' END AS r6
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(r1, r2, r3, r4, r5, r6) IS NULL AS kept, concat_ws(',', r1, r2, r3, r4, r5, r6) AS broken
FROM j
"""

OP1 = f"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
rules (action, text, rhost, rpath) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fit AS (
  SELECT page_id, max_by(text, length(text)) AS rule, max_by(action, length(text)) AS action
  FROM h, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
said AS (
  SELECT page_id, max_by(phrase, length(phrase)) AS phrase
  FROM h, (SELECT unnest([{_PHRASES}]) AS phrase)
  WHERE regexp_matches(lower(host || path), '(^|[^a-z0-9])' || phrase || '($|[^a-z0-9])') GROUP BY page_id)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN action WHEN phrase IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, phrase
FROM h LEFT JOIN fit USING (page_id) LEFT JOIN said USING (page_id)
"""

# The draw is by MD5, so SQL can follow it; targets are found by giving out what is above the limits, again and again.
OP4 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
fill AS (
  SELECT source, source_size, w, FALSE AS capped, 0.0::DOUBLE AS target, 0 AS turn FROM s
  UNION ALL
  SELECT source, source_size, w, capped OR share >= 3 * source_size,
         CASE WHEN capped OR share >= 3 * source_size THEN (3 * source_size)::DOUBLE ELSE share END, turn + 1
  FROM (
    SELECT *, w * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))
                / sum(w) FILTER (NOT capped) OVER () AS share
    FROM fill) WHERE turn < 60),
targets AS (SELECT source, source_size, target FROM fill WHERE turn = 60),
k AS (
  SELECT doc_id, source, size,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS solid, length(regexp_replace(t, '\\P{L}+', '', 'g')) AS letters,
         (('0x' || substr(md5('17' || chr(1) || doc_id::VARCHAR || chr(1) || md5(t)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d),
r AS (
  SELECT doc_id, size, source_size, target, source,
         -ln(u) / CASE WHEN solid > 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * letters / solid ELSE 0.1::DOUBLE END AS key
  FROM k JOIN targets USING (source)),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM r)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""

# Words are joined by a blank, which no word holds; a window is looked up as its words.
OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
w AS (
  SELECT r, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT r, i, n, item FROM w JOIN g USING (n, gram)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
hit AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN hit USING (r)
"""

ORACLE: dict[str, str] = {
    "op1_url_filter": OP1,
    "op4_source_mix": OP4,
    "op9_quality_rules": OP9,
    "op13_decontaminate": OP13,
}

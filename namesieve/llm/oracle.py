"""DuckDB SQL of the numbered queries that SQL can express.

Models (1, 2), tokens (3's sizes aside, 5, 7) and packing are tested against brute force, exact round
trips or held-out labels in ``tests/llm``.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op9_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g, len(list_slice(w, s, s + 9)) AS n
  FROM items, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g
  FROM docs, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(s)),
hits AS (SELECT doc_id, s, p.n, item_id FROM places p JOIN grams USING (g)),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM hits, unnest(generate_series(s, s + n - 1)) AS t(k) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SQL["op10_substring_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS g
  FROM docs, unnest(generate_series(1, len(w) - 34)) AS t(s)),
twice AS (SELECT g FROM places GROUP BY g HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, k FROM places SEMI JOIN twice USING (g), unnest(generate_series(s, s + 34)) AS t(k)),
words AS (SELECT doc_id, k, w[k] AS word FROM docs, unnest(generate_series(1, len(w))) AS t(k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op6_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, s, s + 4), ' ')) AS g
  FROM words, unnest(generate_series(1, greatest(1, len(w) - 4))) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE c * 10 >= 8 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS class_id,
  (SELECT count(*) FROM links WHERE x = d.doc_id) AS n_links
FROM documents d
"""

SQL["op4_clean_lines"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 4), ' ')) AS g
  FROM docs, unnest(generate_series(1, len(w) - 4)) AS t(s)),
twice AS (SELECT doc_id, g FROM places GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n
  FROM places SEMI JOIN twice USING (doc_id, g), unnest(generate_series(s, s + 4)) AS t(k) GROUP BY doc_id),
each AS (
  SELECT doc_id, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS c, line
  FROM docs, unnest(lines) AS t(line)),
judged AS (
  SELECT doc_id, c, c = '' OR (
    (len(regexp_extract_all(c, '[^\x20\x09-\x0D]+')) < 4 OR regexp_matches(c, '[.!?…。！？:;][\"''”’»)\]]*$'))
    AND len(regexp_extract_all(c, '[|>»›]')) < 3
    AND NOT regexp_matches(c, '(?i)^(?:home|menu|next|previous|back to top|skip to content)$')
    AND NOT regexp_matches(c, '(?i)all rights reserved|cookie (?:policy|settings|preferences)|privacy policy|terms of (?:use|service)|licensed under|spdx-license|copyright|permission is hereby granted|without warrant|enable javascript|subscribe to our|sign up for|click here|log ?in to continue|share this')
    AND len(regexp_extract_all(c, '[#*$%&|<>]')) <= 0.1 * length(c)
    AND len(regexp_extract_all(c, '[!?*#~=_]')) <= 0.2 * length(c)) AS good FROM each),
left_over AS (
  SELECT doc_id, sum(CASE WHEN good THEN length(regexp_replace(c, '[\x20\x09-\x0D]+', '', 'g')) ELSE 0 END) AS n
  FROM judged GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND l.n >= 0.5 * word_chars AS kept
FROM base JOIN left_over l USING (doc_id)
"""

SQL["op12_filter_audit"] = r"""
WITH marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS mask
  FROM words LEFT JOIN marks USING (doc_id)),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t
  FROM failed GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
cells AS (SELECT o, s, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS before FROM orders, generate_series(1, 5) AS t(s)),
judged AS (
  SELECT part, o, s, x, mask, n, g, t, strpos(mask, x) > 0 AS fails, translate(mask, before, '') = mask AS there
  FROM masks, cells),
totals AS (
  SELECT part, o, s, x,
    coalesce(sum(n) FILTER (there AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (there AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND NOT there), 0) AS redundant, coalesce(sum(n) FILTER (mask = x), 0) AS unique_fails,
    coalesce(sum(g) FILTER (there AND fails), 0) AS good_lost, coalesce(sum(t) FILTER (there AND fails), 0) AS toxic_lost
  FROM judged GROUP BY part, o, s, x)
SELECT part, o AS filter_order, s::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM totals
"""

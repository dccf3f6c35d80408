"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: Exact answer: every pair of documents that shares a shingle is compared.
OP1_MINHASH = r"""
WITH RECURSIVE words AS (
  SELECT doc_id,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id,
    CASE WHEN len(w) = 0 THEN []
      WHEN len(w) < 4 THEN [w]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS p, b.doc_id AS q, any_value(a.n) AS np, any_value(b.n) AS nq, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT p, q FROM common WHERE 100 * shared >= 80 * (np + nq - shared)
  UNION SELECT q, p FROM common WHERE 100 * shared >= 80 * (np + nq - shared)),
reach(p, q) AS (
  SELECT p, q FROM links
  UNION SELECT r.p, l.q FROM reach r JOIN links l ON r.q = l.p),
low AS (SELECT p AS doc_id, min(q) AS q FROM reach GROUP BY p)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  CAST(least(s.doc_id, coalesce(l.q, s.doc_id)) AS BIGINT) AS component_id,
  coalesce(l.q, s.doc_id) >= s.doc_id AS kept
FROM sets s LEFT JOIN low l ON s.doc_id = l.doc_id
"""

OP5_LINE_WINDOWS = r"""
WITH cut AS (
  SELECT doc_id, text, coalesce(string_split(text, chr(10)), []) AS lines FROM documents),
windows AS (
  SELECT doc_id, pos, lines[pos:pos + 2] AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM cut)
  WHERE regexp_matches(array_to_string(lines[pos:pos + 2], ''), '[^\x20\x09-\x0D]')),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM windows),
gone AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS ps FROM ranked WHERE n > 1 GROUP BY doc_id)
SELECT c.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  CASE WHEN ps IS NULL THEN text ELSE
    array_to_string(list_filter(lines, lambda l, i: NOT list_contains(ps, i)), chr(10)) END AS text
FROM cut c LEFT JOIN gone g ON c.doc_id = g.doc_id
"""

OP3_HOST_RULES = r"""
WITH cut AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM cut),
grams AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) AS n FROM starts),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM grams WHERE n > 1) GROUP BY doc_id),
measured AS (
  SELECT c.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words
  FROM cut c LEFT JOIN covered v ON c.doc_id = v.doc_id),
hosts AS (
  SELECT host, count(*) AS docs,
    [count(*) FILTER (n_words < 50), count(*) FILTER (100 * n_repeat_words > 50 * n_words),
     count(*) FILTER (10 * n_symbols > n_words), count(*) FILTER (10 * n_dup_lines > 3 * n_lines)] AS failed
  FROM measured WHERE host IS NOT NULL GROUP BY host),
rules AS (SELECT host, docs, unnest(failed) AS k, generate_subscripts(failed, 1) AS r FROM hosts),
moments AS (SELECT r, avg(k / docs) AS m, var_pop(k / docs) AS v, avg(1 / docs) AS few FROM rules GROUP BY r),
priors AS (
  SELECT r, m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * few, 1e-9) - 1, 1), 1e6) AS s FROM moments),
verdicts AS (
  SELECT host, bool_or(p > least(m + 0.05, 0.5)) AS failed, list(round(p, 6) ORDER BY r) AS rates
  FROM (SELECT host, rules.r, m, (k + m * s) / (docs + s) AS p FROM rules JOIN priors ON rules.r = priors.r)
  GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  coalesce(failed, false) AS host_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(failed, false) AS kept,
  rates[1] AS rate_short, rates[2] AS rate_repetitive, rates[3] AS rate_symbols, rates[4] AS rate_lines
FROM measured m LEFT JOIN verdicts v ON m.host = v.host
"""

OP6_WARC = r"""
WITH records AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest
  FROM pages),
coded AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, CAST(i * 5 + 1 AS BIGINT), 5))::BIGINT) AS parts,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters
  FROM records)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(parts, lambda c:
    letters[(c // 32768) % 32 + 1] || letters[(c // 1024) % 32 + 1] || letters[(c // 32) % 32 + 1] || letters[c % 32 + 1]),
    '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM coded
"""

OP8_SUBSTRINGS = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM cut)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS q FROM ranked WHERE n > 1),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM cut),
rest AS (
  SELECT words.doc_id, count(gone.q) AS n, string_agg(x, ' ' ORDER BY words.q) FILTER (gone.q IS NULL) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q GROUP BY words.doc_id)
SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM cut c LEFT JOIN rest r ON c.doc_id = r.doc_id
"""

#: Exact in DOUBLE: whole numbers far below 2 ** 53.
OP13_HARD_NEGATIVES = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS slot
  FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY slot <= 5),
mined AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id,
    n.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.slot ORDER BY n.score DESC, n.vec_id) AS place
  FROM positives p JOIN scored n ON p.rid = n.rid
  WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM mined WHERE place <= 3
"""

ORACLE: dict[str, str] = {
    "op1_minhash": OP1_MINHASH,
    "op3_host_rules": OP3_HOST_RULES,
    "op5_line_windows": OP5_LINE_WINDOWS,
    "op6_warc": OP6_WARC,
    "op8_substrings": OP8_SUBSTRINGS,
    "op13_hard_negatives": OP13_HARD_NEGATIVES,
}

"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Documents as words from the bytes' point of view: A-Z lowered, words of letters, digits and non-ASCII characters.
ORACLES["op7_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(list_slice(words, i, i + least(13, len(words)) - 1), ' ') AS gram
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 12))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT row_id, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS gram
  FROM (SELECT row_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, sizes WHERE len(words) >= n)),
found AS (SELECT row_id, g.n, i, item_id FROM grams g JOIN windows w ON g.gram = w.gram AND g.n = w.n),
hit AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY row_id),
items AS (
  SELECT row_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT row_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (row_id) LEFT JOIN items USING (row_id)
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op9_prefix_suffix_trees"] = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS words FROM documents),
grams AS (
  SELECT row_id, doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS gram
  FROM (SELECT row_id, doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM d WHERE len(words) >= 13)),
least_doc AS (SELECT gram, min(doc_id) AS least FROM grams GROUP BY gram),
hit AS (
  SELECT DISTINCT row_id, unnest(generate_series(i, i + 12)) AS p
  FROM grams JOIN least_doc USING (gram) WHERE least < doc_id),
word AS (SELECT row_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d),
kept AS (
  SELECT word.row_id, string_agg(w, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN hit ON word.row_id = hit.row_id AND word.p = hit.p
  GROUP BY word.row_id),
lost AS (SELECT row_id, count(*) AS n FROM hit GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (row_id) LEFT JOIN kept USING (row_id)
"""

# Bytes as pairs of hex digits.
ORACLES["op8_deep_shallow"] = """
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, hex(coalesce(text, '')) AS x FROM documents),
grams AS (
  SELECT row_id, i, md5(substr(x, 2 * i + 1, 400)) AS gram
  FROM (SELECT row_id, x, unnest(generate_series(0, len(x) // 2 - 200)) AS i FROM d WHERE len(x) >= 400)),
twice AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1),
hit AS (SELECT row_id, i, lag(i) OVER (PARTITION BY row_id ORDER BY i) AS before FROM grams SEMI JOIN twice USING (gram)),
islands AS (SELECT row_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS island FROM hit),
spans AS (SELECT row_id, min(i) AS a, max(i) + 200 AS b FROM islands GROUP BY row_id, island),
edges AS (SELECT row_id, a, b, lag(b, 1, 0) OVER (PARTITION BY row_id ORDER BY a) AS from_byte FROM spans),
kept AS (
  SELECT d.row_id, string_agg(substr(x, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS t,
    sum(b - a) AS n_removed, count(*) AS n_spans
  FROM edges JOIN d USING (row_id) GROUP BY d.row_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (row_id)
"""

_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOUND = " UNION ALL ".join(
    f"SELECT row_id, text, {k} AS rank, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d"
    for k, (kind, pattern) in enumerate(
        {
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
            "card": r"[0-9](?:[\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        }.items()
    )
)
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda i:
  CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT)
  ELSE CAST(substr(reverse({_DIGITS}), i, 1) AS INT) * 2 - CASE WHEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

# The same thresholds as the default policy.
ORACLES["op2_pii_disclosure"] = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
hits AS (
  SELECT row_id, text, rank, kind, unnest(m) AS value, unnest(list_slice(g, 1, len(m))) AS gap, generate_subscripts(m, 1) AS i
  FROM found WHERE len(m) > 0),
placed AS (
  SELECT row_id, text, rank, kind, value,
    CAST(sum(length(gap) + length(value)) OVER (PARTITION BY row_id, kind ORDER BY i) AS INT) AS b
  FROM hits),
base AS (
  SELECT row_id, text, rank, kind, value, b - length(value) AS a, b FROM placed
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}
    ELSE length({_DIGITS}) BETWEEN 8 AND 15 END),
entities AS (SELECT DISTINCT row_id, md5(text) AS sha, kind || ':' || lower(value) AS entity FROM base),
n_entity AS (SELECT entity, count(*) AS n_entity, count(DISTINCT sha) AS texts FROM entities GROUP BY entity),
words AS (SELECT DISTINCT row_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_LETTERS}{{4,}}')) AS term FROM d),
n_term AS (SELECT term, count(*) AS n_term FROM words GROUP BY term),
near AS (SELECT row_id, sha, entity, term FROM entities JOIN words USING (row_id)),
n_both AS (SELECT entity, term, count(*) AS n_both, count(DISTINCT sha) AS both_texts FROM near GROUP BY entity, term),
told AS (
  SELECT entity, term, CASE WHEN n_entity < n_docs
    THEN ln(n_docs * n_both / (n_entity * (n_term + CASE WHEN both_texts < 3 THEN 1 ELSE 0 END))) / ln(n_docs / n_entity) ELSE 0.0 END AS told
  FROM n_both JOIN n_entity USING (entity) JOIN n_term USING (term), (SELECT count(*) AS n_docs FROM d)
  WHERE both_texts >= 3 OR 2 * both_texts >= texts),
mine AS (SELECT row_id, term, max(told) AS told FROM near JOIN told USING (entity, term) WHERE told >= 0.8 GROUP BY row_id, term),
runs AS (
  SELECT row_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_LETTERS}+')) AS term,
    unnest(list_slice(string_split_regex(text, '{_LETTERS}+'), 1, len(regexp_extract_all(text, '{_LETTERS}+')))) AS gap,
    generate_subscripts(regexp_extract_all(text, '{_LETTERS}+'), 1) AS i
  FROM d WHERE row_id IN (SELECT row_id FROM mine)),
run_spans AS (SELECT row_id, term, CAST(sum(length(gap) + length(term)) OVER (PARTITION BY row_id ORDER BY i) AS INT) AS b FROM runs),
terms AS (
  SELECT row_id, CASE WHEN told >= 0.95 THEN 5 ELSE 4 END AS rank, CASE WHEN told >= 0.95 THEN 'remove' ELSE 'generalise' END AS kind,
    b - length(term) AS a, b
  FROM run_spans r JOIN mine USING (row_id, term)
  WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.row_id = r.row_id AND x.a < r.b AND r.b - length(r.term) < x.b)),
spans AS (SELECT row_id, rank, kind, a, b FROM base UNION ALL SELECT * FROM terms),
sums AS (
  SELECT row_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rank, a) FILTER (rank < 4) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rank, a) AS every
  FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN sums USING (row_id)
"""

ORACLES["op1_revisit_asof"] = r"""
WITH p AS (
  SELECT page_id, html, url, CASE WHEN page_id % 3 = 0 THEN url || '#top' ELSE regexp_replace(url, '^http://', 'HTTP://') END AS other,
    '"' || substr(md5(html), 1, 16) || '"' AS tag, regexp_extract(url, '^(https?://[^/]+)', 1) || '/' AS front, '"f' || page_id % 5 || '"' AS front_tag,
    1700000000 + page_id // 4 * 244 AS base, 'day ' || page_id % 2 AS changed FROM pages),
records AS (
  SELECT page_id * 4 AS record_id, url AS uri, base AS at, true AS is_full, false AS is_front, page_id, sha256(html) AS digest, tag, NULL AS changed FROM p
  UNION ALL
  SELECT page_id * 4 + 1, other, base + (page_id % 5) * 40000 + 7, false, false, page_id, NULL,
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"stale"' ELSE 'W/' || tag END, NULL FROM p
  UNION ALL
  SELECT page_id * 4 + 2, front, base + 10, true, true, page_id, sha256(front_tag), front_tag, changed FROM p
  UNION ALL
  SELECT page_id * 4 + 3, front || '?utm_source=x', base + (page_id % 3) * 2440 + 10, false, true, page_id, NULL,
    CASE WHEN page_id % 4 = 1 THEN NULL ELSE 'W/' || front_tag END, changed FROM p),
cut AS (
  SELECT *, regexp_replace(trim(uri), '#.*$', '') AS u FROM records),
parts AS (
  SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
    lower(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1), '^.*@', '')) AS host,
    regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid|sid)(?:=|$)'))), '&') AS query
  FROM cut),
named AS (
  SELECT *, CASE WHEN scheme = '' THEN u ELSE scheme || '://' ||
      CASE scheme WHEN 'http' THEN regexp_replace(host, ':(?:80)?$', '') WHEN 'https' THEN regexp_replace(host, ':(?:443)?$', '') ELSE host END ||
      CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canon
  FROM parts),
found AS (
  SELECT v.record_id, v.canon, v.is_front, v.page_id, v.tag, v.changed,
    max(struct_pack(at := r.at, id := r.record_id, page_id := r.page_id, tag := r.tag, changed := r.changed, digest := r.digest)) AS r
  FROM named v LEFT JOIN named r ON r.is_full AND r.canon = v.canon AND r.at < v.at
  WHERE NOT v.is_full GROUP BY ALL),
outcomes AS (
  SELECT *, 'max-age=' || page_id % 100 AS cache, CAST(page_id % 13 AS VARCHAR) AS age,
    CASE WHEN r.id IS NULL THEN 'no_response' WHEN tag IS NOT NULL AND regexp_replace(tag, '^W/', '') = r.tag THEN 'resolved' WHEN tag IS NOT NULL THEN 'mismatch'
    WHEN changed IS NULL OR r.changed IS NULL THEN 'unchecked' WHEN changed = r.changed THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found)
SELECT record_id, canon AS url, r.id AS response_id, outcome,
  concat_ws(chr(10), CASE WHEN NOT is_front THEN 'age: ' || age END, 'cache-control: ' || cache,
    CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' WHEN NOT is_front THEN 'content-type: text/plain' END,
    'etag: ' || CASE WHEN outcome = 'resolved' THEN coalesce(tag, r.tag) ELSE tag END, 'last-modified: ' || changed, CASE WHEN outcome = 'resolved' THEN 'server: s' || r.page_id % 9 END) AS headers,
  CASE WHEN outcome = 'resolved' THEN r.digest END AS digest
FROM outcomes
"""

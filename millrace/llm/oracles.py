"""SQL that gives the same rows as a query, by another path, where SQL can."""

from __future__ import annotations

from millrace.llm.url_filters import GENERAL

OP5 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_LISTED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_LONGEST = sorted(_LISTED, key=lambda r: -len(r[0] + r[1]))
_GENERAL = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in GENERAL)

OP6 = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST)} END AS "rule",
       CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for h, p, v in _LONGEST)}
            WHEN {_GENERAL} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""

OP8 = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-0-' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY source),
-- sources reach their caps in the order of cap by weight: those before the first that stays below are clamped
filled AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM sources
  WINDOW before AS (ORDER BY 2.0 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest, open_weight FROM filled WHERE rest * weight / open_weight <= 2 * source_size
  ORDER BY 2.0 * source_size / weight, encode(source) NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, level.rest * weight::DOUBLE / level.open_weight::DOUBLE) AS target
  FROM sources, level),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, whole, round(target)::BIGINT - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, (whole * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM placed
"""

OP11 = r"""
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
-- crc32 bit by bit: the bytes of the decimal number, each followed by seven further steps
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                            lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384)), 4294967295) % 4 AS few FROM turns),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(o.seq[1:c.few], []), c.seq[c.few + 1:]) AS seq
  FROM hashed c LEFT JOIN turns o ON o.conv_id = c.conv_id - c.conv_id % 20),
members AS (SELECT conv_id, seq[1:depth] AS node, depth, len(seq) = depth AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         coalesce(len(regexp_extract_all(node[-1].text, '[^\x20\x09-\x0D]+')), 0) AS words
  FROM members GROUP BY node),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
sums AS (
  SELECT node[1:above] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (node) LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.node[1:c.depth - 1]
"""

OP12 = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
strings AS (
  SELECT doc_id, place, md5(substr(digits, 2 * place + 1, 200)) AS string
  FROM (SELECT doc_id, digits, unnest(range(0, n_bytes - 99)) AS place FROM texts)),
repeated AS (SELECT doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY string ORDER BY doc_id, place) AS nth FROM strings) WHERE nth > 1),
parted AS (SELECT *, coalesce(place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 100, true) AS new FROM repeated),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM parted),
spans AS (SELECT doc_id, min(place) AS since, max(place) + 100 AS stop FROM numbered GROUP BY doc_id, span),
-- what stays lies from each span's stop, or 0, to the next one's since, or the end
gaps AS (
  SELECT doc_id, stop AS since, lead(since) OVER (PARTITION BY doc_id ORDER BY since) AS stop FROM spans
  UNION ALL SELECT doc_id, 0, min(since) FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(digits, 2 * since + 1, 2 * (coalesce(stop, n_bytes) - since)), '' ORDER BY since) AS digits
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(stop - since)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.digits, t.digits))) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

ORACLES = {"op5_exact_dedup": OP5, "op6_url_filters": OP6, "op8_mixing": OP8, "op11_prefix_trie": OP11, "op12_suffix_dedup": OP12}

"""DuckDB SQL for the queries that SQL can express."""

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATTERNS = (
    "^//([^/]*[.])?adult-",
    "^//([^/]*[.])?casino[^a-z0-9]",
    "^//([^/]*[.])?phishing[^a-z0-9]",
    "^//([^/]*[.])?porn[^a-z0-9]",
    "^//([^/]*[.])?warez[^a-z0-9]",
    "/wp-login[.]",
    "[^a-z0-9]torrent[^a-z0-9]",
    "[^a-z0-9]utm_medium=spam[^a-z0-9]",
)
_BLOCKED = " OR ".join(f"regexp_matches(whole, '{p}')" for p in _PATTERNS)

URLS = f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
b AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             '//' || translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole FROM a),
r(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
      ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (SELECT b.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
      FROM b JOIN r ON (b.host = r.host OR b.host LIKE '%.' || r.host) AND starts_with(b.path, r.path) GROUP BY 1)
SELECT b.page_id, b.host, b.path, f.rule,
       coalesce(f.verdict, CASE WHEN NOT contains(whole, '/robots.txt') AND ({_BLOCKED}) THEN 'block' ELSE 'allow' END)
         AS verdict
FROM b LEFT JOIN f ON b.page_id = f.page_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM s
"""

NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k
  FROM s WHERE same AND vec_id <> anchor_id),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id,
    s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND p.k <= 5
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op5_url_filter": URLS,
    "op8_exact_dedup": EXACT,
    "op10_warc_round_trip": WARC,
    "op12_hard_negatives": NEGATIVES,
}

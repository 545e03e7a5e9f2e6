"""Checking SQL (DuckDB) for the registered queries.

Written from the definitions, independent of the DataFrame code; only the view
expressions are shared. A query without an entry fits a model.
"""

from __future__ import annotations

from primrose.functions.stopwords import STOP_WORDS
from primrose.functions.text import PUNCTUATION
from primrose.plans.queries import CAPTURE_CAP, CHUNK_LIMIT
from primrose.plans.views import (
    ARTICLE_COLS,
    FEED_PARTS,
    FETCHED_COLS,
    GRID_COLS,
    MESSAGE_COLS,
    RATING_COLS,
    RATING_ORDER,
    REPLY_EXPR,
    SCORED_COLS,
    SLOT_COLS,
    STORED_RULE,
    STORED_TWICE_RULE,
)

SLOTS = [f"turk_rating{i}" for i in range(5)]


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cols(exprs: list[str]) -> str:
    return ", ".join(exprs).replace("AS STRING", "AS VARCHAR")


def links(text: str) -> str:
    return (
        rf"list_filter(regexp_extract_all({text}, '(https?://[\w./]*\w{{1}})', 1),"
        " lambda x: length(split_part(x, '://', 2)) > 5)"
    )


def key_of(link: str) -> str:
    return f"CAST('0x' || substr(md5({link}), 1, 15) AS BIGINT)"


# The entities the given pages hold (others are proved by contract tests).
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]


def visible(html: str) -> str:
    hidden = (
        r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
        r"|<!--.*?-->|<!doctype[^>]*>"
    )
    out = f"regexp_replace({html}, '{hidden}', '', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for entity, character in ENTITIES:
        out = f"replace({out}, {lit(entity)}, {lit(character)})"
    out = rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"
    return f"replace({out}, chr(10), ' ')"


def simple(text: str) -> str:
    return rf"string_split(lower(regexp_replace({text}, '\W', ' ', 'g')), ' ')"


def words(text: str) -> str:
    return (
        rf"list_transform(list_filter(regexp_extract_all({text}, "
        r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'), "
        f"lambda x: instr({lit(PUNCTUATION)}, x) = 0), lambda x: lower(x))"
    )


STOP = "(" + ", ".join(lit(w) for w in STOP_WORDS) + ")"

ARTICLES = f"articles AS (SELECT {cols(ARTICLE_COLS)} FROM documents LEFT JOIN labels USING (doc_id))"
VALIDITY = f"""{ARTICLES}, judged AS (
  SELECT *, CASE WHEN reporter_content IS NULL THEN 'null'
    WHEN reporter_content = 'None' THEN 'none'
    WHEN contains(reporter_content, 'Thanks for Registering!') THEN 'registration_wall'
    ELSE 'ok' END AS reason FROM articles)"""
SPLIT = f"""{VALIDITY}, placed AS (
  SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id) AS r,
    count(*) OVER () AS n FROM judged WHERE reason = 'ok'),
split AS (SELECT id, CASE WHEN r <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS part
  FROM placed)"""
MESSAGES = f"messages AS (SELECT {cols(MESSAGE_COLS)} FROM events)"
EXPLODED = f"""{MESSAGES}, found AS (SELECT *, {links('text')} AS l FROM messages),
exploded AS (SELECT * EXCLUDE (l), unnest(range(1, len(l) + 1)) - 1 AS pos, unnest(l) AS link FROM found)"""
LINKS = f"""{EXPLODED}, links AS (
  SELECT id * 100 + pos AS id, lang, text, source, link, possibly_sensitive, crawled FROM exploded),
pending AS (SELECT id, link FROM links WHERE NOT crawled)"""
FETCHED = f"fetched AS (SELECT {cols(FETCHED_COLS)} FROM pages)"
CRAWLED = f"""{LINKS}, {FETCHED}, attached AS (
  SELECT p.id, p.link, f.link_actual, f.page_text, f.link IS NOT NULL AS fetched
  FROM pending p LEFT JOIN fetched f ON p.link = f.link),
outcome AS (SELECT id, link,
  CASE WHEN NOT fetched OR page_text IS NULL OR page_text = ''
    OR regexp_matches(page_text, '[_{{}}]') THEN 'None' ELSE page_text END AS page_text,
  CASE WHEN fetched THEN 'None' ELSE 'error visiting' END AS errors,
  CASE WHEN fetched THEN link_actual ELSE 'None' END AS link_actual FROM attached)"""
LISTING = "listing AS (" + " UNION ALL ".join(
    f"SELECT url AS link, {rating.replace('array(', 'list_value(')} AS rating, "
    f"CAST({feed} AS INT) AS feed_ord, {item} AS item_ord FROM pages WHERE {rule}"
    for feed, item, rating, rule in FEED_PARTS
) + ")"
FEEDS = f"""{LISTING}, flagged AS (SELECT *,
  CASE WHEN coalesce(list_contains(rating, 'adult'), false) THEN 1 ELSE 0 END AS flag FROM listing),
items AS (SELECT {key_of('link')} AS id, link, flag, feed_ord, item_ord FROM flagged),
last_in_feed AS (SELECT *, row_number() OVER (PARTITION BY id, feed_ord ORDER BY item_ord DESC) AS k
  FROM items),
first_feed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY feed_ord) AS j
  FROM last_in_feed WHERE k = 1),
best AS (SELECT id, link, flag, feed_ord, item_ord FROM first_feed WHERE j = 1),
stored AS (SELECT {key_of('url')} AS id, url AS link FROM pages WHERE {STORED_RULE}
  UNION ALL SELECT {key_of('url')}, url FROM pages WHERE {STORED_TWICE_RULE})"""
REPLIES = f"""replies AS (SELECT {key_of('url')} AS id, {REPLY_EXPR.replace('AS STRING', 'AS VARCHAR')} AS reply
  FROM pages),
parsed AS (SELECT id, json_extract_string(reply, '$.title') AS title,
  json_extract_string(reply, '$.content') AS content FROM replies)"""

_order = ", ".join(RATING_ORDER)
ASSIGNED = f"""slots AS (SELECT {cols(SLOT_COLS)} FROM orders),
ratings AS (SELECT {cols(RATING_COLS)} FROM lineitem),
numbered AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY {_order}) AS k FROM ratings
  WHERE rating <> ''),
cells AS (SELECT id, slot, content FROM (
  {' UNION ALL '.join(f"SELECT id, {i} AS slot, {c} AS content FROM slots" for i, c in enumerate(SLOTS))})),
empties AS (SELECT id, slot, row_number() OVER (PARTITION BY id ORDER BY slot) AS k
  FROM cells WHERE content = ''),
assigned AS (SELECT n.file, n.link_id, n.rating, e.slot FROM numbered n
  JOIN empties e ON n.link_id = e.id AND n.k = e.k)"""
FILLED = f"""{ASSIGNED}, filled AS (
  SELECT s.id, any_value(s.link) AS link,
  {', '.join(f"coalesce(max(CASE WHEN a.slot = {i} THEN a.rating END), any_value(s.{c})) AS {c}" for i, c in enumerate(SLOTS))}
  FROM slots s LEFT JOIN assigned a ON s.id = a.link_id GROUP BY s.id)"""
_given = " + ".join(f"(CASE WHEN {c} <> '' THEN 1 ELSE 0 END)" for c in SLOTS)
_sum = " + ".join(f"(CASE WHEN {c} <> '' THEN CAST(nullif({c}, '') AS INT) ELSE 0 END)" for c in SLOTS)
RATED = f"""{FILLED}, counted AS (SELECT *, {_given} AS c, {_sum} AS s FROM filled),
rated AS (SELECT id, link, c AS count_turk_ratings,
  CASE WHEN c > 0 THEN CAST(s AS DOUBLE) / c END AS avg_turk_ratings FROM counted)"""
SCORED = f"scored AS (SELECT {cols(SCORED_COLS)} FROM labels)"
CLASSES = f"""{SCORED}, tallies AS (
  SELECT c.class, count(*) FILTER (label = c.class AND prediction = c.class) AS tp,
    count(*) FILTER (prediction = c.class) AS predicted,
    count(*) FILTER (label = c.class) AS support
  FROM scored, (VALUES (0), (1)) AS c(class) GROUP BY c.class),
rates AS (SELECT class, CAST(tp AS DOUBLE) / nullif(predicted, 0) AS p,
  CAST(tp AS DOUBLE) / nullif(support, 0) AS r, support FROM tallies),
report AS (SELECT CAST(class AS VARCHAR) AS class, coalesce(p, 0) AS precision,
  coalesce(r, 0) AS recall,
  CASE WHEN coalesce(p, 0) = 0 OR coalesce(r, 0) = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1,
  support FROM rates)"""
FOLDS = f"""{SCORED}, tallies AS (SELECT doc_id % 10 AS fold,
    count(*) FILTER (label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (prediction = 1) AS predicted,
    count(*) FILTER (label = 1) AS support FROM scored GROUP BY 1),
folds AS (SELECT fold, CASE WHEN tp = 0 THEN 0.0::DOUBLE
  ELSE 2 * (CAST(tp AS DOUBLE) / predicted) * (CAST(tp AS DOUBLE) / support)
    / ((CAST(tp AS DOUBLE) / predicted) + (CAST(tp AS DOUBLE) / support)) END AS f1 FROM tallies)"""
LABELLED = """labelled AS (SELECT doc_id, text, CAST(toxic AS INT) AS label
  FROM documents JOIN labels USING (doc_id))"""


def pairs_of(source: str) -> str:
    """Bigram rows of ``source`` (doc_id, text and the rest)."""
    return f"""tokenised AS (SELECT *, {words('text')} AS w FROM {source}),
pairs AS (SELECT * EXCLUDE (w, i), w[i] AS w1, w[i + 1] AS w2 FROM (
  SELECT *, unnest(range(1, len(w))) AS i FROM tokenised))"""


BIGRAM_COUNTS = f"""{LABELLED}, {pairs_of('labelled')},
counts AS (SELECT label, w1, w2, count(*) AS n FROM pairs
  WHERE length(w1) > 3 OR length(w2) > 3 GROUP BY ALL)"""
TOP = f"""{BIGRAM_COUNTS}, totals AS (SELECT CAST(sum(n) FILTER (label = 1) AS DOUBLE) AS tp,
    CAST(sum(n) FILTER (label = 0) AS DOUBLE) AS tn FROM counts),
both_labels AS (SELECT w1, w2, coalesce(sum(n) FILTER (label = 1), 0)::BIGINT AS n_pos,
    coalesce(sum(n) FILTER (label = 0), 0)::BIGINT AS n_neg FROM counts GROUP BY ALL),
top AS (SELECT w1, w2, n_pos, n_neg,
    abs(coalesce(n_pos / tp, 0) - coalesce(n_neg / tn, 0)) AS diff
  FROM both_labels, totals WHERE n_pos >= 3 OR n_neg >= 3
  ORDER BY diff DESC, w1 DESC, w2 DESC LIMIT 1000)"""
HELD = f"""{TOP}, held AS (SELECT DISTINCT doc_id, w1 || ' ' || w2 AS feature
  FROM pairs JOIN (SELECT w1, w2 FROM top) USING (w1, w2))"""


def terms_of(source: str, pattern: str, stop: bool) -> str:
    keep = f"WHERE term NOT IN {STOP}" if stop else ""
    return f"""SELECT doc_id, term, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{pattern}')) AS term FROM {source})
  {keep} GROUP BY ALL"""


TWO_LETTERS = r"[\p{L}\p{N}_]{2,}"
NGRAMS = rf"""kept AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\w+'),
  lambda x: x NOT IN {STOP}) AS w FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)),
  lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM kept),
ngrams AS (SELECT doc_id, term, count(*) AS n FROM grams GROUP BY ALL)"""
DOC_PARTS = """doc_parts AS (SELECT doc_id, text, CASE WHEN r <= floor(n * 0.75) THEN 'train'
  ELSE 'test' END AS part FROM (SELECT doc_id, text,
  row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS r,
  count(*) OVER () AS n FROM documents))"""
PRESENCE = f"SELECT DISTINCT doc_id, unnest({simple('text')}) AS feature FROM documents"


def bayes(features: str) -> str:
    """Counts and likelihoods from ``features`` (doc_id, label, feature)."""
    return f"""sizes AS (SELECT count(*) FILTER (label = 0) AS n0,
    count(*) FILTER (label = 1) AS n1 FROM labelled),
tally AS (SELECT feature, count(*) FILTER (label = 0) AS t0, count(*) FILTER (label = 1) AS t1
  FROM {features} GROUP BY feature),
wide AS (SELECT feature, t0, t1, n0 - t0 AS a0, n1 - t1 AS a1, n0, n1,
  CASE WHEN n0 - t0 + n1 - t1 > 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS b FROM tally, sizes),
probs AS (SELECT *, (t0 + 0.5::DOUBLE) / (n0 + 0.5::DOUBLE * b) AS pt0,
  (t1 + 0.5::DOUBLE) / (n1 + 0.5::DOUBLE * b) AS pt1,
  (a0 + 0.5::DOUBLE) / (n0 + 0.5::DOUBLE * b) AS pa0,
  (a1 + 0.5::DOUBLE) / (n1 + 0.5::DOUBLE * b) AS pa1 FROM wide),
prior AS (SELECT ln((n0 + 0.5::DOUBLE) / (n0 + n1 + 1.0::DOUBLE)) AS l0,
  ln((n1 + 0.5::DOUBLE) / (n0 + n1 + 1.0::DOUBLE)) AS l1 FROM sizes)"""


BAYES = f"""{LABELLED}, single AS (SELECT DISTINCT doc_id, label, unnest({simple('text')}) AS feature
  FROM labelled), {bayes('single')}"""

DESCRIBE = """SELECT count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM {t}"""

SIZED = "sized AS (SELECT doc_id AS id, lang AS filename, strlen(text) AS size FROM documents)"
UNFLAGGED = f"""{ARTICLES}, unflagged AS (SELECT id, link || '#' || CAST(id AS VARCHAR) AS link,
  row_number() OVER (ORDER BY id) - 1 AS z FROM articles WHERE sensitive_flag = 0),
batches AS (SELECT id, link, z // 3 AS batch, z % 3 AS pos FROM unflagged),
triples AS (SELECT batch, max(link) FILTER (pos = 0) AS site1, max(link) FILTER (pos = 1) AS site2,
  max(link) FILTER (pos = 2) AS site3 FROM batches GROUP BY batch)"""
SNAPSHOTS = """names AS (SELECT event_type || '_@' || strftime(ts, '%m-%d-%Y_%H-%M') || '.pk1' AS name
  FROM events)"""
GRID = f"grid AS (SELECT {cols(GRID_COLS)} FROM lineitem)"
GRID_LINKS = f"""{GRID}, cells AS (
  SELECT site1 AS site, row_no * 3 AS ord FROM grid
  UNION ALL SELECT site2, row_no * 3 + 1 FROM grid
  UNION ALL SELECT site3, row_no * 3 + 2 FROM grid),
keyed AS (SELECT CAST(split_part(site, '#', 2) AS BIGINT) AS link_id, site AS link, ord FROM cells),
last_seen AS (SELECT *, count(*) OVER (PARTITION BY link_id) AS times,
  row_number() OVER (PARTITION BY link_id ORDER BY ord DESC, link DESC) AS k FROM keyed),
labelled_links AS (SELECT link_id, times, link FROM last_seen WHERE k = 1)"""
CAPTURED = (
    f"WITH {MESSAGES} SELECT text, possibly_sensitive, source, lang FROM messages"
    " WHERE possibly_sensitive IS NOT NULL AND lang = 'en'"
)
CRAWLED_LINKS = f"""WITH {EXPLODED}, {FETCHED} SELECT e.id, e.pos, e.link,
  CASE WHEN f.link IS NULL THEN 'error visiting' ELSE 'None' END AS errors,
  coalesce(f.link_actual, 'None') AS link_actual,
  CASE WHEN f.page_text IS NULL OR f.page_text = '' OR regexp_matches(f.page_text, '[_{{}}]')
    THEN 'None' ELSE f.page_text END AS page_text, true AS crawled
  FROM exploded e LEFT JOIN fetched f ON e.link = f.link"""
BOUNDED = f"""FROM messages WHERE possibly_sensitive IS NOT NULL AND lang = 'en'
  ORDER BY ts, id LIMIT {CAPTURE_CAP}"""


def chunked(limit: int) -> str:
    return f"""{SIZED}, run AS (SELECT *, CAST(sum(size) OVER (PARTITION BY filename ORDER BY id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM sized)
SELECT id, filename, size, {{extra}} (running - size) // {limit} AS chunk FROM run"""


PROBA = f"""WITH {BAYES}, sums AS (SELECT doc_id, sum(ln(pt0)) AS g0, sum(ln(pt1)) AS g1
          FROM ({PRESENCE}) JOIN probs USING (feature) GROUP BY doc_id),
        gaps AS (SELECT d.doc_id, greatest(least(l0 + coalesce(g0, 0) - l1 - coalesce(g1, 0), 700.0::DOUBLE),
          -700.0::DOUBLE) AS gap FROM documents d LEFT JOIN sums USING (doc_id), prior)
        SELECT doc_id, round(1 - 1 / (1 + exp(gap)), 6) AS p0, round(1 / (1 + exp(gap)), 6) AS p1 FROM gaps"""

def _bits(a: str, b: str) -> str:
    """Entropy of two counts."""
    part = "CASE WHEN {x} > 0 THEN -({x} / ({n})) * log2({x} / ({n})) ELSE 0 END"
    return f"({part.format(x=a, n=f'{a} + {b}')} + {part.format(x=b, n=f'{a} + {b}')})"


LABELLED_PARTS = """joined AS (SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
doc_parts AS (SELECT doc_id, text, CASE WHEN r <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS part
  FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS r,
    count(*) OVER () AS n FROM joined))"""
OPTIMALITY = f"""WITH {LABELLED_PARTS}, train AS ({terms_of("doc_parts WHERE part = 'train'", TWO_LETTERS, True)})
SELECT term AS feature, count(*) AS docs, CAST(sum(n) AS BIGINT) AS total, true AS optimal FROM train GROUP BY term"""
TREE = f"""WITH joined AS (SELECT doc_id, text, toxic AS label FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)),
has AS (SELECT DISTINCT doc_id, label, unnest({simple('text')}) AS feature FROM joined),
n AS (SELECT CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS n1 FROM joined),
t AS (SELECT feature, count(*) FILTER (label = 0) AS t0, count(*) FILTER (label = 1) AS t1
  FROM has WHERE feature <> '' GROUP BY feature),
g AS (SELECT *, n0 - t0 AS a0, n1 - t1 AS a1, t0::DOUBLE AS p0, t1::DOUBLE AS p1 FROM t, n WHERE t0 + t1 < n0 + n1),
best AS (SELECT * FROM g WHERE round({_bits('n0', 'n1')} - ((p0 + p1) * {_bits('p0', 'p1')} + (a0 + a1) * {_bits('a0', 'a1')}) / (n0 + n1), 10) > 0
  ORDER BY round({_bits('n0', 'n1')} - ((p0 + p1) * {_bits('p0', 'p1')} + (a0 + a1) * {_bits('a0', 'a1')}) / (n0 + n1), 10) DESC, feature LIMIT 1),
nodes AS (SELECT '' AS node, n0, n1, (SELECT feature FROM best) AS split FROM n
  UNION ALL SELECT '1', p0, p1, NULL FROM best UNION ALL SELECT '0', a0, a1, NULL FROM best)
SELECT node, CAST(nodes.n0 AS BIGINT) AS n0, CAST(nodes.n1 AS BIGINT) AS n1, split,
  CAST(n.n0 AS BIGINT) AS leaves_n0, CAST(n.n1 AS BIGINT) AS leaves_n1 FROM nodes, n"""

BAYES_FOLDS = f"""WITH joined AS (SELECT doc_id, text, toxic AS label,
    CAST((row_number() OVER (ORDER BY toxic, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 10 AS INT) AS fold
  FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
has AS (SELECT DISTINCT doc_id, label, fold, unnest({simple('text')}) AS feature FROM joined),
own AS (SELECT feature, fold, count(*) FILTER (label = 0) AS t0, count(*) FILTER (label = 1) AS t1 FROM has GROUP BY ALL),
every AS (SELECT feature, sum(t0) AS t0, sum(t1) AS t1 FROM own GROUP BY feature),
size AS (SELECT fold, (SELECT count(*) FILTER (label = 0) FROM joined) - count(*) FILTER (label = 0) AS m0,
  (SELECT count(*) FILTER (label = 1) FROM joined) - count(*) FILTER (label = 1) AS m1 FROM joined GROUP BY fold),
model AS (SELECT o.feature, o.fold, e.t0 - o.t0 AS r0, e.t1 - o.t1 AS r1, m0, m1,
    CASE WHEN m0 + m1 > e.t0 - o.t0 + e.t1 - o.t1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS b
  FROM own o JOIN every e USING (feature) JOIN size USING (fold)),
gains AS (SELECT doc_id, sum(ln((r0 + 0.5::DOUBLE) / (m0 + 0.5::DOUBLE * b))) AS g0,
    sum(ln((r1 + 0.5::DOUBLE) / (m1 + 0.5::DOUBLE * b))) AS g1
  FROM has JOIN model USING (feature, fold) WHERE r0 + r1 > 0 GROUP BY doc_id),
judged AS (SELECT fold, label, CASE WHEN ln((m1 + 0.5::DOUBLE) / (m0 + m1 + 1.0::DOUBLE)) + coalesce(g1, 0)
    >= ln((m0 + 0.5::DOUBLE) / (m0 + m1 + 1.0::DOUBLE)) + coalesce(g0, 0) THEN 1 ELSE 0 END AS prediction
  FROM joined JOIN size USING (fold) LEFT JOIN gains USING (doc_id))
SELECT fold, round(CASE WHEN sum(label + prediction) > 0 THEN 2.0::DOUBLE * sum(label * prediction) / sum(label + prediction)
  ELSE 0 END, 6) AS f1 FROM judged GROUP BY fold"""

ORACLE: dict[str, str] = {
    # sources
    "scan_articles": f"""WITH {ARTICLES} SELECT id, link, title, parser_content, reporter_content,
        sensitive_flag, {', '.join(SLOTS)} FROM articles""",
    "scan_message_json": CAPTURED,
    "scan_feed_items": f"""WITH {LISTING} SELECT link,
        CASE WHEN rating IS NOT NULL THEN array_to_string(rating, ',') END AS ratings FROM listing""",
    "scan_annotation_batches": f"""WITH {GRID} SELECT site1, site2, site3, answer1, answer2,
        nullif(answer3, '') AS answer3 FROM grid""",
    "scan_id_grid": """SELECT CAST(id AS VARCHAR) AS id, count(*) AS n FROM (
        SELECT l_orderkey AS id FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY 1""",
    "scan_latest_snapshot": f"WITH {SPLIT} SELECT id FROM split WHERE part = 'train'",
    # sinks
    "write_messages_json": CAPTURED,
    "write_chunked_json": f"WITH {chunked(CHUNK_LIMIT * 64).format(extra='')}",
    "append_messages": f"""WITH {EXPLODED} SELECT id, lang, source, link, possibly_sensitive,
        false AS crawled FROM exploded WHERE lang <> 'fr'""",
    "insert_new_articles": f"""WITH {FEEDS} SELECT DISTINCT id, link, CAST(NULL AS INT) AS sensitive_flag
        FROM stored UNION ALL
        SELECT id, link, flag FROM best WHERE id NOT IN (SELECT id FROM stored)""",
    "merge_crawl_results": f"""WITH {CRAWLED} SELECT l.id, l.link,
        CASE WHEN o.id IS NOT NULL THEN true ELSE l.crawled END AS crawled,
        o.errors, o.link_actual, o.page_text FROM links l LEFT JOIN outcome o ON l.id = o.id""",
    "write_annotation_csv": f"""WITH {UNFLAGGED} SELECT site1, site2, site3 FROM triples
        WHERE batch < (SELECT max(batch) FROM triples)""",
    "write_link_flags_csv": f"WITH {FEEDS} SELECT link, flag FROM best",
    "write_split_snapshot": f"WITH {SPLIT} SELECT id, part, '12-07-2013_11-41' AS stamp FROM split",
    "rating_audit_log": f"""WITH {ASSIGNED} SELECT file AS filename, link_id, rating,
        'turk_rating' || CAST(slot AS VARCHAR) AS "column" FROM assigned""",
    # projections and filters
    "filter_messages": f"""WITH {MESSAGES} SELECT id, lang, possibly_sensitive FROM messages
        WHERE possibly_sensitive IS NOT NULL AND lang = 'en'""",
    "filter_raw_messages": f"WITH {MESSAGES} SELECT id FROM messages WHERE lang = 'en'",
    "project_messages": f"WITH {MESSAGES} SELECT text, possibly_sensitive, source, lang FROM messages",
    "pending_links": f"WITH {LINKS} SELECT id, link FROM pending",
    "classify_validity": f"WITH {VALIDITY} SELECT id, reason FROM judged",
    "valid_rows": f"WITH {VALIDITY} SELECT id, reporter_content FROM judged WHERE reason = 'ok'",
    "problem_report": f"WITH {VALIDITY} SELECT id, reason FROM judged WHERE reason <> 'ok'",
    "drop_registration_wall": f"""WITH {VALIDITY} SELECT id FROM judged WHERE reporter_content IS NULL
        OR NOT contains(reporter_content, 'Thanks for Registering!')""",
    "candidates_by_flag": f"""WITH {VALIDITY} SELECT id, sensitive_flag FROM judged
        WHERE (sensitive_flag = 1 AND reason NOT IN ('none', 'registration_wall'))
           OR (sensitive_flag = 0 AND reason <> 'none')""",
    "sensitive_links": f"""WITH {VALIDITY} SELECT link FROM judged
        WHERE sensitive_flag = 1 AND reason NOT IN ('none', 'registration_wall')""",
    "long_enough": f"""WITH {ARTICLES}, sized AS (SELECT id,
        len(string_split({visible('parser_content')}, ' ')) AS content_len FROM articles)
        SELECT id, content_len FROM sized WHERE content_len >= 100""",
    "min_ratings": f"WITH {RATED} SELECT id, count_turk_ratings FROM rated WHERE count_turk_ratings >= 3",
    "agreed_sensitive": f"""WITH {RATED} SELECT round(avg_turk_ratings, 6) AS avg_turk_ratings, link
        FROM rated WHERE avg_turk_ratings > 0.5 AND count_turk_ratings >= 5""",
    "blank_template_text": f"""WITH {FETCHED} SELECT link, link_actual,
        CASE WHEN NOT regexp_matches(page_text, '[_{{}}]') THEN page_text END AS page_text FROM fetched""",
    "fill_none": f"""WITH {REPLIES} SELECT id, coalesce(title, 'None') AS title,
        coalesce(content, 'None') AS content, coalesce(content, 'None') AS reporter_content FROM parsed""",
    "crawl_outcome": f"WITH {CRAWLED} SELECT * FROM outcome",
    "article_label_projection": f"""WITH {RATED} SELECT link,
        round(avg_turk_ratings, 6) AS avg_turk_ratings, count_turk_ratings FROM rated""",
    # joins
    "stored_status": f"""WITH {FEEDS} SELECT id, link,
        (SELECT count(*) FROM stored s WHERE s.id = best.id) = 1 AS in_db FROM best""",
    "new_items": f"""WITH {FEEDS} SELECT id, link, flag FROM best
        WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.id = best.id)""",
    "attach_pages": f"WITH {CRAWLED} SELECT id, link, link_actual, page_text, fetched FROM attached",
    "attach_crawled": f"""WITH {EXPLODED}, {FETCHED} SELECT e.id, e.pos, e.link AS link_followed,
        f.link_actual, f.page_text, '' AS errors FROM exploded e JOIN fetched f ON e.link = f.link""",
    "merge_api_record": f"""WITH {FEEDS}, {REPLIES} SELECT b.id, b.link,
        coalesce(p.title, b.link) AS title, p.content FROM best b LEFT JOIN parsed p ON b.id = p.id""",
    "select_split": f"""WITH {SPLIT} SELECT id, link, sensitive_flag, part
        FROM articles JOIN split USING (id)""",
    "only_known_ids": """SELECT o_orderkey AS id FROM orders
        WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem)""",
    "match_ratings": f"""WITH {ASSIGNED} SELECT link_id, rating, file, row_no, pos, {', '.join(SLOTS)}
        FROM ratings JOIN slots ON link_id = id""",
    "unmatched_ratings": f"""WITH {ASSIGNED} SELECT link_id, rating FROM ratings
        WHERE link_id NOT IN (SELECT id FROM slots)""",
    "apply_vocabulary": f"""WITH {DOC_PARTS},
        train AS ({terms_of("doc_parts WHERE part = 'train'", TWO_LETTERS, True)}),
        test AS ({terms_of("doc_parts WHERE part = 'test'", TWO_LETTERS, True)})
        SELECT doc_id, term, n FROM test WHERE term IN (SELECT term FROM train)""",
    "bigram_presence": f"""WITH {HELD} SELECT l.doc_id,
        coalesce(string_agg(feature, '|' ORDER BY feature), '') AS present
        FROM labelled l LEFT JOIN held USING (doc_id) GROUP BY l.doc_id""",
    "labelled_features": f"""SELECT doc_id, feature, toxic AS label FROM ({PRESENCE})
        JOIN labels USING (doc_id)""",
    # aggregations
    "pending_count": f"WITH {LINKS} SELECT count(id) AS pending FROM pending",
    "count_ratings": f"WITH {RATED} SELECT id, count_turk_ratings FROM rated",
    "mean_rating": f"WITH {RATED} SELECT id, round(avg_turk_ratings, 6) AS avg_turk_ratings FROM rated",
    "total_ratings": f"""WITH {RATED} SELECT CAST(sum(count_turk_ratings) AS BIGINT) AS total_ratings
        FROM rated""",
    "describe_column": f"WITH {RATED} {DESCRIBE.format(c='avg_turk_ratings', t='rated')}",
    "describe_column_prices": DESCRIBE.format(c="o_totalprice", t="orders"),
    "value_counts": f"""WITH {RATED} SELECT round(avg_turk_ratings, 6) AS avg_turk_ratings, count(*) AS n
        FROM rated WHERE avg_turk_ratings IS NOT NULL GROUP BY avg_turk_ratings""",
    "binned_counts": f"""WITH {RATED}, binned AS (SELECT CASE WHEN avg_turk_ratings > 0.75 THEN '(0.75, 1]'
        WHEN avg_turk_ratings > 0.5 THEN '(0.5, 0.75]' WHEN avg_turk_ratings > 0.25 THEN '(0.25, 0.5]'
        WHEN avg_turk_ratings > 0 THEN '(0, 0.25]' END AS bin FROM rated)
        SELECT bin, count(*) AS n FROM binned WHERE bin IS NOT NULL GROUP BY bin""",
    "candidate_counts": f"""WITH {VALIDITY} SELECT sensitive_flag, count(*) AS n FROM judged
        WHERE reason <> 'none' AND (sensitive_flag = 0 OR reason <> 'registration_wall')
        GROUP BY sensitive_flag""",
    "corpus_stats": f"""WITH t AS (SELECT doc_id, unnest({simple('text')}) AS token FROM documents)
        SELECT count(DISTINCT doc_id) AS documents, count(*) AS words,
        round(CAST(count(*) AS DOUBLE) / count(DISTINCT doc_id), 6) AS mean_words,
        count(DISTINCT token) AS vocabulary FROM t""",
    "term_frequencies": f"""SELECT term, CAST(sum(n) AS BIGINT) AS n
        FROM ({terms_of('documents', TWO_LETTERS, True)}) GROUP BY term""",
    "document_frequencies": f"""SELECT term, count(DISTINCT doc_id) AS df
        FROM ({terms_of('documents', TWO_LETTERS, False)}) GROUP BY term""",
    "label_bigram_counts": f"WITH {BIGRAM_COUNTS} SELECT label, w1, w2, n FROM counts",
    "label_bigram_probs": f"""WITH {BIGRAM_COUNTS} SELECT label, w1, w2, n,
        round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE), 9) AS prob FROM counts""",
    "split_consistency": f"""WITH {SPLIT} SELECT (SELECT count(*) FROM judged WHERE reason = 'ok') AS valid_rows,
        count(*) AS saved_rows,
        (SELECT count(*) FROM judged WHERE reason = 'ok') = count(*) AS consistent FROM split""",
    "adult_flag": f"WITH {FEEDS} SELECT link, feed_ord, item_ord, flag FROM flagged",
    "confusion_counts": f"WITH {SCORED} SELECT label, prediction, count(*) AS n FROM scored GROUP BY ALL",
    "precision_recall_f": f"""WITH {CLASSES} SELECT class, round(p, 6) AS precision, round(r, 6) AS recall,
        round(CASE WHEN p = 0 OR r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f_measure FROM rates""",
    "f1_score": f"WITH {CLASSES} SELECT round(f1, 6) AS f1 FROM report WHERE class = '1'",
    "classification_report": f"""WITH {CLASSES} SELECT class, round(precision, 6) AS precision,
        round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report UNION ALL
        SELECT 'avg / total', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
        CAST(sum(support) AS BIGINT) FROM report""",
    "last_in_batch": f"""WITH {LINKS}, b AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch
        FROM pending) SELECT batch, max(id) AS last_id FROM b GROUP BY batch""",
    "partial_label_counts": f"WITH {GRID_LINKS} SELECT link_id, times, link FROM labelled_links",
    "partial_batches": f"""WITH {GRID_LINKS}, z AS (SELECT times, link,
          row_number() OVER (PARTITION BY times ORDER BY link_id) - 1 AS z FROM labelled_links),
        t AS (SELECT times, z // 3 AS batch, max(link) FILTER (z % 3 = 0) AS site1,
          max(link) FILTER (z % 3 = 1) AS site2, max(link) FILTER (z % 3 = 2) AS site3
          FROM z GROUP BY ALL)
        SELECT times, batch, site1, site2, site3 FROM t
        WHERE batch < (SELECT max(u.batch) FROM t u WHERE u.times = t.times)""",
    "fold_f1": f"WITH {FOLDS} SELECT fold, round(f1, 6) AS f1 FROM folds",
    "cv_summary": f"""WITH {FOLDS} SELECT round(avg(f1), 6) AS mean_f1,
        round(stddev_pop(f1) * 2, 6) AS spread FROM folds""",
    # positions
    "row_index": f"WITH {ARTICLES} SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_idx FROM articles",
    "commit_batches": f"""WITH {LINKS} SELECT id, link,
        (row_number() OVER (ORDER BY id) - 1) // 100 AS batch FROM pending""",
    "size_chunks": f"WITH {chunked(CHUNK_LIMIT).format(extra='running,')}",
    "progress_marks": f"""WITH {SIZED}, run AS (SELECT row_number() OVER (ORDER BY id) AS rows_so_far,
        sum(size) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS b FROM sized)
        SELECT rows_so_far, round(CAST(b AS DOUBLE) / 1048576, 6) AS mb_so_far FROM run
        WHERE rows_so_far % 100 = 0""",
    "fill_rating_slots": f"WITH {FILLED} SELECT id, link, {', '.join(SLOTS)} FROM filled",
    "annotation_batches": f"""WITH {UNFLAGGED} SELECT batch, site1, site2, site3 FROM triples
        WHERE batch < (SELECT max(batch) FROM triples)""",
    "annotation_batches_all": f"WITH {UNFLAGGED} SELECT batch, site1, site2, site3 FROM triples",
    "train_test_split": f"WITH {SPLIT} SELECT id, part FROM split",
    "first_feed_wins": f"WITH {FEEDS} SELECT * FROM best",
    "adjacent_bigrams": f"""WITH {pairs_of('documents')} SELECT w1, w2, count(*) AS n FROM pairs GROUP BY ALL""",
    "shuffle_in_batch": f"""WITH {UNFLAGGED} SELECT batch, id, row_number() OVER (PARTITION BY batch
        ORDER BY md5(CAST(id AS VARCHAR) || '#42'), id) - 1 AS pos FROM batches""",
    # sorts and limits
    "bounded_capture": f"WITH {MESSAGES} SELECT id, text {BOUNDED}",
    "next_pending": f"WITH {LINKS} SELECT id, link FROM pending ORDER BY id LIMIT 100",
    "latest_snapshot": f"""WITH {SNAPSHOTS}, timed AS (SELECT name,
        strptime(regexp_extract(name, '@([^.]*)', 1), '%m-%d-%Y_%H-%M') AS t FROM names)
        SELECT name, strftime(t, '%m-%d-%Y_%H-%M') AS stamp FROM timed ORDER BY t DESC, name LIMIT 1""",
    "ranked_terms": f"WITH {NGRAMS} SELECT term, CAST(sum(n) AS BIGINT) AS n FROM ngrams GROUP BY term",
    "top_bigrams": f"WITH {TOP} SELECT w1, w2, n_pos, n_neg, round(diff, 9) AS diff FROM top",
    "informative_features": f"""WITH {BAYES}, observed AS (
        SELECT feature, 'true' AS value, CASE WHEN t0 > 0 THEN pt0 END AS p0,
          CASE WHEN t1 > 0 THEN pt1 END AS p1 FROM probs UNION ALL
        SELECT feature, 'absent', CASE WHEN a0 > 0 THEN pa0 END, CASE WHEN a1 > 0 THEN pa1 END FROM probs)
        SELECT feature, value, round(greatest(p0, p1) / least(p0, p1), 6) AS ratio FROM observed
        WHERE p0 IS NOT NULL OR p1 IS NOT NULL
        ORDER BY greatest(p0, p1) / least(p0, p1) DESC, feature, value LIMIT 50""",
    # set operations
    "bigram_universe": f"""WITH {BIGRAM_COUNTS} SELECT w1, w2 FROM counts WHERE label = 1
        UNION SELECT w1, w2 FROM counts WHERE label = 0""",
    "distinct_ids": "SELECT DISTINCT l_partkey AS id FROM lineitem",
    "vocabulary": f"SELECT DISTINCT unnest({simple('text')}) AS token FROM documents",
    "hit_set": f"""WITH {SCORED} SELECT doc_id FROM scored WHERE label = 1
        INTERSECT SELECT doc_id FROM scored WHERE prediction = 1""",
    "union_feeds": """SELECT url AS link, 'pages' AS feed, 0 AS feed_ord FROM pages
        UNION ALL SELECT s_name, 'shops', 1 FROM supplier UNION ALL SELECT p_name, 'goods', 2 FROM part""",
    "combined_features": f"""WITH {HELD}, single AS (SELECT DISTINCT doc_id, unnest({simple('text')}) AS feature
        FROM labelled) SELECT doc_id, feature FROM single UNION ALL SELECT doc_id, feature FROM held""",
    # scalar functions
    "extract_links": f"""WITH {MESSAGES} SELECT id, array_to_string({links('text')}, ' ') AS links FROM messages
        UNION ALL SELECT -page_id - 1, array_to_string({links('url')}, ' ') FROM pages""",
    "explode_links": f"WITH {EXPLODED} SELECT id, pos, link FROM exploded",
    "unpivot_ratings": f"""WITH {GRID}, cells AS (
          SELECT file, row_no, 0 AS pos, site1 AS site, answer1 AS rating FROM grid
          UNION ALL SELECT file, row_no, 1, site2, answer2 FROM grid
          UNION ALL SELECT file, row_no, 2, site3, answer3 FROM grid)
        SELECT file, row_no, pos, rating, split_part(site, '#', 1) AS link,
          CAST(split_part(site, '#', 2) AS BIGINT) AS link_id FROM cells""",
    "html_to_text": f"SELECT page_id, {visible('html')} AS content FROM pages",
    "simple_tokens": f"SELECT doc_id, array_to_string({simple('text')}, '|') AS tokens FROM documents",
    "word_tokens": f"SELECT doc_id, array_to_string({words('text')}, chr(10)) AS tokens FROM documents",
    "bigram_length_filter": f"""WITH {pairs_of('documents')} SELECT doc_id, count(*) AS n FROM pairs
        WHERE length(w1) > 3 OR length(w2) > 3 GROUP BY doc_id""",
    "stamp_name": """SELECT event_id, strftime(ts, '%m-%d-%Y_%H-%M') AS split_stamp,
        strftime(ts, '%m-%d-%Y_%H_%M') AS feed_stamp FROM events""",
    "parse_snapshot_time": f"""WITH {SNAPSHOTS} SELECT name,
        strftime(strptime(regexp_extract(name, '@([^.]*)', 1), '%m-%d-%Y_%H-%M'), '%Y-%m-%d %H:%M:%S') AS time
        FROM names""",
    "word_count": "SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents",
    "link_key": f"SELECT page_id, {key_of('url')} AS key FROM pages",
    "rating_bin": """SELECT l_orderkey, l_linenumber, l_discount, CASE
        WHEN l_discount * 10 <= 0 OR l_discount * 10 > 1 THEN NULL
        WHEN l_discount * 10 <= 0.25 THEN '(0, 0.25]' WHEN l_discount * 10 <= 0.5 THEN '(0.25, 0.5]'
        WHEN l_discount * 10 <= 0.75 THEN '(0.5, 0.75]' ELSE '(0.75, 1]' END AS bin FROM lineitem""",
    "sensitive_label": f"""WITH {RATED} SELECT id, CASE WHEN avg_turk_ratings >= 0.5 THEN 1 ELSE 0 END AS label
        FROM rated""",
    "compose_link_id": f"WITH {ARTICLES} SELECT id, link || '#' || CAST(id AS VARCHAR) AS site FROM articles",
    "split_link_id": """SELECT page_id, CASE WHEN contains(url, '#') THEN substr(url, 1, instr(url, '#') - 1)
        ELSE url END AS link, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#') + 1) END AS link_id
        FROM pages""",
    "clip80": """SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END
        AS clipped FROM documents""",
    "count_terms": terms_of("documents", TWO_LETTERS, True),
    "ngram_terms": f"WITH {NGRAMS} SELECT doc_id, term, n FROM ngrams",
    "tfidf_terms": f"""WITH tf AS ({terms_of('documents', TWO_LETTERS, False)}),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        weighted AS (SELECT doc_id, term, n * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents))
          / (1.0::DOUBLE + df)) + 1.0) AS w FROM tf JOIN df USING (term))
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
        FROM weighted""",
    "word_presence": PRESENCE,
    "parse_reply": f"WITH {REPLIES} SELECT id, title, content FROM parsed",
    # learning
    "fit_logistic_optimality": OPTIMALITY,
    "decision_tree_nodes": TREE,
    "cross_validate_f1_bayes": BAYES_FOLDS,
    "naive_bayes_table": f"""WITH {BAYES} SELECT label, feature, value, n, round(prob, 9) AS prob FROM (
        SELECT 0 AS label, feature, 'true' AS value, t0 AS n, pt0 AS prob, t0 + t1 AS seen FROM probs
        UNION ALL SELECT 1, feature, 'true', t1, pt1, t0 + t1 FROM probs
        UNION ALL SELECT 0, feature, 'absent', a0, pa0, a0 + a1 FROM probs
        UNION ALL SELECT 1, feature, 'absent', a1, pa1, a0 + a1 FROM probs) WHERE seen > 0""",
    "naive_bayes_predict": f"""WITH {BAYES}, sums AS (SELECT doc_id, sum(ln(pt0)) AS g0, sum(ln(pt1)) AS g1
          FROM ({PRESENCE}) JOIN probs USING (feature) GROUP BY doc_id),
        scores AS (SELECT d.doc_id, l0 + coalesce(g0, 0) AS s0, l1 + coalesce(g1, 0) AS s1
          FROM documents d LEFT JOIN sums USING (doc_id), prior)
        SELECT doc_id, round(s0, 6) AS score0, round(s1, 6) AS score1,
        CASE WHEN s1 >= s0 THEN 1 ELSE 0 END AS prediction FROM scores""",
    "naive_bayes_predict_bigrams": f"""WITH {HELD}, marked AS (SELECT doc_id, label, feature
          FROM held JOIN labelled USING (doc_id)), {bayes('marked')},
        every AS (SELECT sum(ln(pa0)) AS b0, sum(ln(pa1)) AS b1 FROM probs),
        sums AS (SELECT doc_id, sum(ln(pt0) - ln(pa0)) AS g0, sum(ln(pt1) - ln(pa1)) AS g1
          FROM held JOIN probs USING (feature) GROUP BY doc_id),
        scores AS (SELECT d.doc_id, l0 + b0 + coalesce(g0, 0) AS s0, l1 + b1 + coalesce(g1, 0) AS s1
          FROM labelled d LEFT JOIN sums USING (doc_id), prior, every)
        SELECT doc_id, round(s0, 6) AS score0, round(s1, 6) AS score1,
        CASE WHEN s1 >= s0 THEN 1 ELSE 0 END AS prediction FROM scores""",
    "predict_proba_bayes": PROBA,
    "write_probabilities_bayes": PROBA,
    "coefficient_density_bayes": f"""WITH {BAYES} SELECT count(*) AS dimensionality,
        round(avg(CASE WHEN ln(pt1) - ln(pt0) <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS density
        FROM probs""",
    "top_coefficients_bayes": f"""WITH {BAYES}, coefs AS (SELECT feature, ln(pt1) - ln(pt0) AS coef FROM probs),
        placed AS (SELECT *, row_number() OVER (ORDER BY coef DESC, feature) AS place FROM coefs)
        SELECT feature, round(coef, 9) AS coef, CAST(place AS INT) AS place,
        CAST((place - 1) // 10 + 1 AS INT) AS band FROM placed WHERE place <= 30""",
    # streams
    "stream_capture": CAPTURED,
    "stream_bounded": f"WITH {MESSAGES} SELECT text, possibly_sensitive, source, lang {BOUNDED}",
    "stream_links": CRAWLED_LINKS,
    "stream_message_table": CRAWLED_LINKS,
    "stream_new_articles": f"""WITH {FEEDS} SELECT id, link, flag FROM best
        WHERE id NOT IN (SELECT id FROM stored)""",
    "stream_ratings": f"WITH {FILLED} SELECT id, link, {', '.join(SLOTS)} FROM filled",
    "stream_rating_changes": f"WITH {FILLED} SELECT id, link, {', '.join(SLOTS)} FROM filled",
}

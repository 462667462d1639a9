"""SQL for the queries that SQL can express, written from their definitions and not from their methods."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda k: array_to_string(ws[k:k + 34], ' '))) AS words FROM w WHERE len(ws) >= 35),
twice AS (SELECT words FROM win GROUP BY words HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN twice USING (words)),
marked AS (SELECT p.doc_id, p.i, p.word, gone.i IS NOT NULL AS out FROM p LEFT JOIN gone USING (doc_id, i)),
agg AS (SELECT doc_id, count(*) AS n_words, sum(out::BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT out), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN agg USING (doc_id)
"""

NEARDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS doc, doc_id AS other FROM n UNION SELECT reach.doc, edge.b FROM reach JOIN edge ON edge.a = reach.other),
comp AS (SELECT doc, min(other) AS component_id FROM reach GROUP BY doc)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.doc = d.doc_id
"""

#: levenshtein() counts bytes: letters of more than one byte (30 at most, as in `documents`) go to control characters first.
LINES = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND text <> ''),
letters AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS wide FROM (SELECT DISTINCT unnest(string_split(line, '')) AS c FROM l) WHERE strlen(c) > 1),
codes AS (SELECT string_agg(chr(i::INT), '' ORDER BY i) AS narrow FROM range(1, 32) r(i) WHERE i <> 10),
firsts AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first, length(line) AS n FROM l WHERE line <> '' GROUP BY line),
long AS (SELECT line, first, n, translate(line, wide, narrow) AS bytes FROM firsts, letters, codes WHERE n >= 20),
thirds AS (SELECT line, first, n, bytes, n AS m, unnest([0, 1, 2]) AS third, unnest([left(line, n // 3), substr(line, n // 3 + 1, n // 3), right(line, n // 3)]) AS part FROM long),
lengths AS (SELECT *, unnest([n, n - 1, n - 2]) AS m FROM long),
looked AS (
  SELECT *, 0 AS third, left(line, m // 3) AS part FROM lengths
  UNION ALL SELECT *, 1, unnest(list_transform([-2, -1, 0, 1, 2], lambda t: substr(line, m // 3 + 1 + t, m // 3))) FROM lengths
  UNION ALL SELECT *, 2, right(line, m // 3) FROM lengths),
near AS (SELECT DISTINCT a.line AS a, b.line AS b, a.first AS fa, b.first AS fb FROM thirds a JOIN looked b USING (m, third, part) WHERE a.line <> b.line AND levenshtein(a.bytes, b.bytes) <= 2),
late AS (SELECT b AS line FROM near WHERE fa < fb UNION SELECT a FROM near WHERE fb < fa),
marked AS (SELECT l.*, l.line = '' OR (firsts.first = {'d': l.doc_id, 'p': l.pos} AND late.line IS NULL) AS stays
  FROM l LEFT JOIN firsts ON firsts.line = l.line LEFT JOIN late ON late.line = l.line),
agg AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN agg USING (doc_id)
"""

SHARDS = r"""
WITH h AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 15))::BIGINT AS hash FROM documents),
t AS (SELECT *, unnest(range(0, 61)) AS depth FROM h),
s AS (SELECT doc_id, n_bytes, hash, depth, sum(n_bytes) OVER w AS bytes, min(hash) OVER w AS low, max(hash) OVER w AS high FROM t WINDOW w AS (PARTITION BY depth, hash >> (60 - depth))),
leaf AS (SELECT doc_id, n_bytes, hash, min(depth) AS depth FROM s WHERE bytes <= {limit} OR low = high GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(hash >> (60 - depth)), depth::INT, '0') END AS shard, n_bytes FROM leaf
"""

URLS = r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {rules}),
parts AS (SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
tags AS (SELECT url, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM parts WHERE contains(url, '://')),
targets AS (SELECT url, path, replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1)
    ELSE '' END, '&amp;', '&') AS target FROM tags),
raw AS (SELECT url AS a, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^[^:]*:') || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || target
    WHEN path = '' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || '/' || target
    ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*') || regexp_replace(path, '[^/]*$', '') || target END AS b FROM targets WHERE target <> ''),
nodes AS (SELECT u, translate(regexp_extract(u, '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ||
    CASE WHEN starts_with(regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS url
    FROM (SELECT a AS u FROM raw UNION SELECT b FROM raw UNION SELECT url FROM parts WHERE contains(url, '://')) WHERE contains(u, '://')),
edge AS (SELECT x.url AS a, y.url AS b FROM raw JOIN nodes x ON x.u = raw.a JOIN nodes y ON y.u = raw.b UNION SELECT y.url, x.url FROM raw JOIN nodes x ON x.u = raw.a JOIN nodes y ON y.u = raw.b),
reach AS (SELECT DISTINCT a AS url, a AS other FROM edge UNION SELECT reach.url, edge.b FROM reach JOIN edge ON edge.a = reach.other),
own AS (SELECT url, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT other AS url FROM reach)),
member AS (SELECT own.url, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM own JOIN rules r ON (own.host = r.host OR ends_with(own.host, '.' || r.host)) AND starts_with(own.path, r.path) GROUP BY own.url),
spread AS (SELECT reach.url, min(member.verdict) AS verdict FROM reach JOIN member ON member.url = reach.other GROUP BY reach.url),
ruled AS (SELECT p.page_id, p.url, any_value(p.host) AS host, any_value(p.path) AS path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id, p.url)
SELECT ruled.page_id, ruled.host, ruled.path, ruled.rule, coalesce(ruled.verdict, spread.verdict, 'allow') AS verdict
FROM ruled LEFT JOIN nodes ON nodes.u = ruled.url LEFT JOIN spread ON spread.url = nodes.url
"""


def sql(shard_bytes: int, rules: list[tuple[str, str, str]]) -> dict[str, str]:
    return {
        "op4_substrings": SUBSTRINGS,
        "op7_neardup": NEARDUP,
        "op8_shards": SHARDS.replace("{limit}", str(shard_bytes)),
        "op9_urls": URLS.replace("{rules}", ", ".join(str(r) for r in rules)),
        "op10_lines": LINES,
    }

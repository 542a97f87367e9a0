"""DuckDB SQL that the registered queries must equal, where SQL can say what they compute."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs of documents that share a shingle.
NGRAM_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws FROM documents
), sets AS (
  SELECT DISTINCT doc_id, UNNEST(CASE WHEN LEN(ws) = 0 THEN [] WHEN LEN(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, LEN(ws) - 1)] END) AS gram FROM words
), sizes AS (
  SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS n FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared.n >= 90 * (p.n + q.n - shared.n)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.y FROM reach r JOIN ways w ON w.x = r.other
)
SELECT r.doc_id, COALESCE(MAX(s.n), 0) AS n_shingles, MIN(other) AS component_id FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

#: Every window of every document.
RELATIVE_PARSING = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{_WORDS}') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM (SELECT doc_id, ws, UNNEST(range(1, LEN(ws) - 11)) AS i FROM words)
), earliest AS (
  SELECT w, MIN(doc_id) AS first FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN earliest USING (w), range(13) t(k) WHERE first < doc_id
), every AS (
  SELECT doc_id, UNNEST(ws) AS word, UNNEST(range(1, LEN(ws) + 1)) AS i FROM words
), left_over AS (
  SELECT e.doc_id, COUNT(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS kept FROM every e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT w.doc_id, LEN(ws) AS n_words, LEN(ws) - COALESCE(n, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM words w LEFT JOIN left_over l ON l.doc_id = w.doc_id
"""


def _parts(url: str) -> str:
    """Host, path and alias key of a url."""
    host = rf"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    path = rf"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    query = rf"regexp_extract({url}, '(?s)^.*?://[^?#]*(\?[^#]*)', 1)"
    return f"COALESCE({host}, '') AS host, COALESCE({path}, '') AS path, CASE WHEN {url} LIKE '%://%' THEN {host} || {path} || {query} END AS key"


def redirect_rules(rules: list[tuple[str, str, str]]) -> str:
    """Rules, and blocks carried over links by a recursive walk from the blocked urls."""
    listed = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in rules)
    quoted = r"""\s*=\s*["'']?\s*"""
    return rf"""
WITH RECURSIVE rules(rule_host, rule_path, action) AS (VALUES {listed}
), tags AS (
  SELECT url, UNNEST(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag, {_parts('url')} FROM pages WHERE url LIKE '%://%'
), hrefs AS (
  SELECT *, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel{quoted}canonical\b') THEN regexp_extract(tag, '(?is)\bhref{quoted}([^\s"''>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv{quoted}refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^\s"''>]+)', 1) END AS href FROM tags
), links AS (
  SELECT url, CASE WHEN href LIKE '%://%' THEN href WHEN href LIKE '//%' THEN 'http:' || href WHEN href LIKE '/%' THEN 'http://' || host || href
    ELSE 'http://' || host || COALESCE(NULLIF(regexp_replace(path, '[^/]*$', ''), ''), '/') || href END AS target FROM hrefs WHERE href <> ''
), ends AS (
  SELECT url AS u FROM links UNION SELECT target FROM links UNION SELECT url FROM pages WHERE url IS NOT NULL
), parsed AS (
  SELECT u, {_parts('u')} FROM ends
), ruled AS (
  SELECT u, ARG_MAX(rule_host || rule_path, (LENGTH(rule_host || rule_path), action = 'allow', rule_host || rule_path)) AS rule,
    ARG_MAX(action, (LENGTH(rule_host || rule_path), action = 'allow', rule_host || rule_path)) AS action
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY u
), edges AS (
  SELECT a.key AS x, b.key AS y FROM links JOIN parsed a ON a.u = url JOIN parsed b ON b.u = target
), ways AS (
  SELECT x, y FROM edges UNION ALL SELECT y, x FROM edges
), tainted AS (
  SELECT key FROM ruled JOIN parsed USING (u) WHERE action = 'block' UNION SELECT w.y FROM tainted t JOIN ways w ON w.x = t.key
)
SELECT page_id, COALESCE(p.host, '') AS host, COALESCE(p.path, '') AS path, rule,
  COALESCE(action, CASE WHEN p.key IN (SELECT x FROM ways) AND p.key IN (SELECT key FROM tainted WHERE key IS NOT NULL) THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN parsed p ON p.u = url LEFT JOIN ruled r ON r.u = url
"""

#: The given pages mark their article by its element and its blocks by h1 and p, so SQL can cut them out by name.
BLOCK_RULES = r"""
WITH cut AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(COALESCE(html, ''), '(?is)<article[^>]*>(.*)</article>', 1), '(?i)</?(?:h1|p)>') AS raw FROM pages
), bare AS (
  SELECT page_id, url, list_transform(raw, lambda b: regexp_replace(b, '<[^>]*>', '', 'g')) AS raw FROM cut
), decoded AS (
  SELECT page_id, url, list_transform(raw, lambda b: replace(replace(replace(replace(regexp_replace(replace(replace(
    b, '&quot;', '"'), '&apos;', ''''), '&#(39|x27);', '''', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&')) AS raw FROM bare
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(raw, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks FROM decoded
), joined AS (
  SELECT page_id, url, COALESCE(array_to_string(blocks, chr(10) || chr(10)), '') AS text FROM blocks
)
SELECT page_id, url, text, LENGTH(text) AS n_chars FROM joined
"""

#: Every beginning of every conversation as a row; ancestors are found through the conversations they share.
TURN_TRIE = rf"""
WITH own AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
    ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, o.pos, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 20 AND o.pos <= h
  UNION ALL SELECT i.conv_id, 1, o.pos, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > h
), placed AS (
  SELECT conv_id, text, sha256(to_json([role, text])::VARCHAR) AS turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt
), members AS (
  SELECT conv_id, depth, text, string_agg(turn, ' ') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
  UNION ALL SELECT conv_id, 0, '', '' FROM ids
), lengths AS (
  SELECT conv_id, MAX(depth) AS last FROM members GROUP BY conv_id
), nodes AS (
  SELECT depth, path, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, LEN(regexp_extract_all(ANY_VALUE(text), '{_WORDS}')) AS words,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last) AS ends
  FROM members JOIN lengths USING (conv_id) GROUP BY depth, path
), edges AS (
  SELECT n.depth, n.path, p.path AS above, q.conv_id AS parent FROM nodes n
  JOIN members p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes q ON q.depth = p.depth AND q.path = p.path
), kids AS (
  SELECT depth - 1 AS depth, above AS path, COUNT(*) AS n FROM edges GROUP BY 1, 2
), subtree AS (
  SELECT a.depth, a.path, SUM(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, SUM((d.n_convs - 1) * d.words) AS saved
  FROM nodes d JOIN members a ON a.conv_id = d.conv_id AND a.depth <= d.depth LEFT JOIN kids k ON k.depth = d.depth AND k.path = d.path GROUP BY 1, 2
)
SELECT n.conv_id, n.depth::BIGINT AS depth, e.parent AS parent_conv_id, n.n_convs, COALESCE(k.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(COALESCE(n.ends, '')) AS ends_sha256
FROM nodes n JOIN subtree s USING (depth, path) LEFT JOIN edges e USING (depth, path) LEFT JOIN kids k USING (depth, path)
"""

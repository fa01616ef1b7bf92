"""DuckDB SQL of the flow's plans."""

from __future__ import annotations

from ..params import DEFAULT as P
from . import oracle as o

LIMIT = 30
VIDEO = "coalesce(regexp_matches(url, '^https?://(www\\.)?(youtube\\.com|youtu\\.be)/'), false)"

_FETCHED = "WITH " + o.search_ctes(LIMIT) + """
r AS (SELECT query, page, pos, url, page_id, row_number() OVER (PARTITION BY query ORDER BY page, pos) AS position FROM sr),
f0 AS (SELECT page_id, html, page_id // 12 % 3 = 1 AS is_refused, page_id % 13 = 5 AS raised, coalesce(length(html), 0) = 0 AS failed FROM pages),
f AS (SELECT r.query, r.position, raised, NOT (is_refused OR raised OR failed) AS success, is_refused AND NOT raised AS refused,
             CASE WHEN NOT (is_refused OR raised OR failed) THEN html END AS html,
             CASE WHEN raised THEN 'Timeout after 403 pages' WHEN is_refused THEN 'HTTP 403 Forbidden' WHEN failed THEN 'Connection reset' END AS message,
             (position - 1) // 9 * 3 + CASE WHEN (position - 1) % 9 < 2 THEN 0 WHEN (position - 1) % 9 < 5 THEN 1 ELSE 2 END AS batch
      FROM r JOIN f0 USING (page_id)),
st AS (SELECT query, min(batch) AS stop FROM (SELECT query, batch FROM f GROUP BY ALL HAVING bool_and(refused)) GROUP BY query),
m AS (SELECT f.* FROM f LEFT JOIN st USING (query) WHERE stop IS NULL OR batch <= stop),
z AS (SELECT r.*, m.html, m.success, m.raised, m.message, m.refused, """ + VIDEO + """ AS video FROM r JOIN m USING (query, position)),
e0 AS (SELECT *, CASE WHEN NOT video AND NOT raised THEN """ + o.extract_text("html") + """ END AS content FROM z),
e AS (SELECT *, row_number() OVER (ORDER BY query, page, pos) AS ord,
  CASE WHEN video OR raised THEN 'error' WHEN coalesce(length(content), 0) > """ + f"{P.min_text}" + """ THEN 'scraped' WHEN NOT success THEN 'error' ELSE 'none' END AS outcome,
  CASE WHEN video THEN 'No transcript available' WHEN raised OR (coalesce(length(content), 0) <= """ + f"{P.min_text}" + """ AND NOT success) THEN message END AS error FROM e0)"""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["positional_join"] = o._over_varied(_FETCHED + """
SELECT query, position, page_id, outcome, error, refused, length(content)::BIGINT AS content_len FROM e""")

ORACLE_SQL["fetch_counts"] = o._over_varied(_FETCHED + """
SELECT query, count(*)::BIGINT AS results, count(m.position)::BIGINT AS matched, (count(*) - count(m.position))::BIGINT AS dropped_tail
FROM r LEFT JOIN m USING (query, position) GROUP BY query""")


def _log_sql() -> str:
    bands = ", ".join(f"hash(query, {b}, sig[{b * P.lsh_rows + 1}:{b * P.lsh_rows + P.lsh_rows}])" for b in range(P.lsh_bands))
    score = o._PAGE_SCORE[len(f"WITH {o._PAGES_C},"):]
    sketches = o.minhash_ctes(f"length(text) >= {P.min_content_length}").replace("FROM documents", "FROM texts")
    return o._over_varied("WITH RECURSIVE " + _FETCHED.removeprefix("WITH ") + ",\npc AS (SELECT ord AS page_id, url, html, content FROM e)," + score + """,
texts AS (SELECT ord AS doc_id, content AS text FROM e),""" + sketches + f""",
steps AS MATERIALIZED (SELECT s.doc_id, e.query, [{bands}] AS bks, row_number() OVER (ORDER BY
    (100 - CASE WHEN coalesce(length(e.html), 0) > 0 THEN ps.score ELSE 50 END)::BIGINT * {1 << 56} + s.doc_id) AS step
  FROM sig s JOIN e ON e.ord = s.doc_id JOIN ps ON ps.page_id = s.doc_id),
greedy(step, kept_bks, doc_id, dropped) AS (
  SELECT 0::BIGINT, []::UBIGINT[], NULL::BIGINT, NULL::BOOLEAN
  UNION ALL
  SELECT s.step, CASE WHEN list_has_any(g.kept_bks, s.bks) THEN g.kept_bks ELSE list_concat(g.kept_bks, s.bks) END, s.doc_id, list_has_any(g.kept_bks, s.bks)
  FROM greedy g JOIN steps s ON s.step = g.step + 1)
SELECT r.query, GROUPING(r.query)::INTEGER AS level, count(*)::BIGINT AS total, count_if(e.ord IS NULL)::BIGINT AS dropped_tail,
  count_if(coalesce(e.refused, false))::BIGINT AS blocked, count_if(coalesce(e.outcome = 'scraped', false))::BIGINT AS scraped,
  count_if(coalesce(e.outcome = 'error', false))::BIGINT AS errors, count_if(coalesce(g.dropped, false))::BIGINT AS dedup_removed
FROM r LEFT JOIN e USING (query, position) LEFT JOIN greedy g ON g.doc_id = e.ord GROUP BY GROUPING SETS ((r.query), ())""")


_USABLE = o.entries_ctes() + f""",
u AS (SELECT *, coalesce(score, 50)::DOUBLE * greatest(coalesce(relevance, 0.5), 0.1) AS sort_key
      FROM de WHERE coalesce(length(content), 0) >= {P.min_length} AND coalesce(score, 50) >= {P.min_score})"""

ORACLE_SQL["digest_rank"] = _USABLE + """
SELECT session, ord::BIGINT AS ord, round(sort_key, 6) AS sort_key, row_number() OVER (PARTITION BY session ORDER BY sort_key DESC, ord) AS rank FROM u"""

_PARTS = o.ORACLE_SQL["digest_parts"]
ORACLE_SQL["digest_files"] = _PARTS[: _PARTS.rindex("\nSELECT session, block")] + """,
texts AS (SELECT session, string_split(string_agg(part, chr(10) || chr(10) ORDER BY block, sort_key DESC, ord, part_no), chr(10)) AS lines FROM parts GROUP BY session)
SELECT session, generate_subscripts(lines, 1)::BIGINT AS line_no, unnest(lines) AS line FROM texts"""

ORACLE_SQL["session_files"] = o.entries_ctes() + f"""
SELECT d.source AS session, 'search' AS mode, d.source AS queries, ds.total, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS ord,
  de.title, de.url, md5(d.text) AS content_md5, de.score::BIGINT AS score,
  CASE WHEN d.text IS NULL OR x.strip_len < {P.min_text} THEN 'empty' ELSE array_to_string(x.t_flags, ',') END AS flags,
  CASE WHEN d.text IS NOT NULL AND x.strip_len >= {P.min_text} THEN x.word_count END::BIGINT AS word_count
FROM documents d JOIN x_ts x ON x.k = d.doc_id JOIN de ON de.ord = d.doc_id JOIN ds ON ds.session = d.source"""

ORACLE_SQL["flow_log"] = _log_sql()

_HOSTS = "WITH h AS (SELECT page_id, " + o.url_host(o.canonical("url")) + """ AS host FROM pages)"""

ORACLE_SQL["suffix_domains"] = o._over_varied(_HOSTS + """,
l AS (SELECT DISTINCT host, string_split(host, '.') AS labels, len(string_split(host, '.')) AS n FROM h),
t AS (SELECT DISTINCT labels[n - 1] || '.' || labels[n] AS two, labels[n] AS last FROM l WHERE n >= 2),
rules AS (SELECT last AS base, 'plain' AS kind FROM t UNION SELECT last, 'wild' FROM t WHERE last IN ('org', 'uk')
          UNION SELECT two, 'but' FROM t WHERE last = 'org' AND length(two) >= 11),
fit AS (SELECT l.host, CASE kind WHEN 'plain' THEN 0 WHEN 'wild' THEN 1 ELSE 1000 - 1 END + len(string_split(base, '.')) AS k, n FROM l, rules
        WHERE (l.host = base OR ends_with(l.host, '.' || base)) AND NOT regexp_matches(l.host, '^[0-9]+(\\.[0-9]+){3}\\z')),
b AS (SELECT host, max(k) % 1000 AS k FROM fit WHERE k % 1000 <= n GROUP BY host),
d AS (SELECT l.host, CASE WHEN k > 0 THEN array_to_string(labels[n - k + 1:n], '.') ELSE '' END AS suffix, CASE WHEN k > 0 AND n > k THEN labels[n - k] ELSE '' END AS name
      FROM l LEFT JOIN b USING (host))
SELECT page_id, h.host, CASE WHEN name <> '' THEN name || '.' || suffix ELSE '' END AS domain, name, suffix FROM h JOIN d USING (host)""")

ORACLE_SQL["blocked_hosts"] = o._over_varied(_HOSTS + f""",
x AS (SELECT DISTINCT host FROM h),
bl AS (SELECT unnest({o.lst([d.lower() for d in P.custom_blocked])}) AS domain UNION SELECT 'shop' || c_custkey::VARCHAR || '.com' FROM customer
       UNION SELECT host FROM x WHERE length(host) % 3 = 0 AND host <> '')
SELECT host, host <> '' AND EXISTS (SELECT 1 FROM bl WHERE x.host = bl.domain OR ends_with(x.host, '.' || bl.domain)) AS is_blocked FROM x""")

ORACLE_SQL["transcript_pieces"] = f"""
WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 1 THEN text END AS text FROM conversations),
f AS (SELECT conv_id, turn, {o.strip("'  ' || text || chr(10)")} AS text FROM conversations WHERE conv_id % 7 <> 0),
s AS (SELECT conv_id, CASE WHEN max(length(c.text)) > 0 THEN 'captions' ELSE (SELECT CASE WHEN count(*) > 0 THEN 'fallback' END FROM f WHERE f.conv_id = c.conv_id) END AS source FROM c GROUP BY conv_id),
r AS (SELECT conv_id, turn, coalesce(c.text, '') AS text, source FROM c JOIN s USING (conv_id) WHERE source = 'captions'
      UNION ALL SELECT conv_id, turn, coalesce(f.text, ''), source FROM f JOIN s USING (conv_id) WHERE source = 'fallback'),
p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r),
g AS (SELECT conv_id, source, start // 300 AS part, min(start) AS "offset", string_agg(text, ' ' ORDER BY start, turn, text) AS text FROM p GROUP BY ALL)
SELECT conv_id, source, row_number() OVER (PARTITION BY conv_id ORDER BY part) AS piece_no, "offset", text FROM g"""

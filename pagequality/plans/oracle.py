"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark plans, as plain SQL over the same
parquet views.  Shared fragments (text statistics, HTML extraction, domain
split) are generated by the helpers below.
"""

from __future__ import annotations

import re

from ..operators.minhash import BASE, PRIME, perm_coefficients
from ..params import DEFAULT
from .queries import VARIED
from .varied import ADDRESSES, EMPTY, LETTERS, MARKUP, PAGES_PER_QUERY, PHRASES

P = DEFAULT
WS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+\\z', '', 'g')"


def tokens(e: str) -> str:
    s = strip(e)
    return f"(CASE WHEN length({s}) = 0 THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{WS}+') END)"


def contained(e: str, phrases) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({e}, {q(p)}) THEN 1 ELSE 0 END)" for p in phrases) + ")"


def extract_text(h: str) -> str:
    s = f"regexp_replace({h}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "head", "nav", "footer", "aside"):
        s = f"regexp_replace({s}, '(?is)<{tag}[\\s>].*?</{tag}>', '', 'g')"
    s = (f"regexp_replace({s}, '(?i)</?(p|div|h[1-6]|li|ul|ol|br|tr|table|article|section|blockquote|pre)"
         f"([\\s/][^>]*)?>', {NL}, 'g')")
    s = f"regexp_replace({s}, '<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = f"replace({s}, {q(ent)}, {q(ch)})"
    s = f"regexp_replace({s}, '[ \\t]+', ' ', 'g')"
    s = f"regexp_replace({s}, ' ?\\n[ \\n]*', {NL}, 'g')"
    s = f"regexp_replace({s}, '^[ \\n]+|[ \\n]+\\z', '', 'g')"
    return f"(CASE WHEN coalesce(length({h}), 0) > 0 THEN {s} END)"


def html_to_markdown(h: str) -> str:
    s = f"regexp_replace({h}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "head", "nav", "footer", "aside"):
        s = f"regexp_replace({s}, '(?is)<{tag}[\\s>].*?</{tag}>', '', 'g')"
    s = f"regexp_replace({s}, '(?i)<img[^>]*>', '', 'g')"
    for level in range(1, 7):
        s = (f"regexp_replace({s}, '(?is)<h{level}(\\s[^>]*)?>(.*?)</h{level}>', "
             f"{NL} || {NL} || '{'#' * level} \\2' || {NL} || {NL}, 'g')")
    s = f"regexp_replace({s}, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', '[\\2](\\1)', 'g')"
    s = f"regexp_replace({s}, '(?i)</?(b|strong)(\\s[^>]*)?>', '**', 'g')"
    s = f"regexp_replace({s}, '(?i)</?(i|em)(\\s[^>]*)?>', '*', 'g')"
    s = f"regexp_replace({s}, '(?i)</?code(\\s[^>]*)?>', '`', 'g')"
    s = f"regexp_replace({s}, '(?i)<li(\\s[^>]*)?>', {NL} || '- ', 'g')"
    s = f"regexp_replace({s}, '(?i)<br\\s*/?>', {NL}, 'g')"
    s = (f"regexp_replace({s}, '(?i)</?(p|div|h[1-6]|li|ul|ol|br|tr|table|article|section|blockquote|pre)"
         f"([\\s/][^>]*)?>', {NL} || {NL}, 'g')")
    s = f"regexp_replace({s}, '<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = f"replace({s}, {q(ent)}, {q(ch)})"
    s = f"regexp_replace({s}, '[ \\t]+', ' ', 'g')"
    s = f"regexp_replace({s}, ' *\\n *', {NL}, 'g')"
    s = f"regexp_replace({s}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    s = f"regexp_replace({s}, '^[ \\n]+|[ \\n]+\\z', '', 'g')"
    return f"(CASE WHEN coalesce(length({h}), 0) > 0 THEN {s} END)"


def page_title(h: str) -> str:
    return f"nullif(trim(regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"


def canonical(u: str) -> str:
    return f"regexp_replace({u}, '[?#].*', '')"


def url_host(u: str) -> str:
    return f"coalesce(regexp_replace(lower(split_part(split_part({u}, '//', 2), '/', 1)), '^www\\.', ''), '')"


def url_ext(c: str) -> str:
    return f"lower(regexp_extract({c}, '[^./][^/]*(\\.[^./]*)\\z', 1))"


def host_suffixes(h: str) -> str:
    parts = f"string_split({h}, '.')"
    return (f"(CASE WHEN {h} = '' THEN []::VARCHAR[] ELSE "
            f"list_transform(range(1, len({parts}) + 1), lambda i: array_to_string(({parts})[i:len({parts})], '.')) END)")


def page_type(u: str) -> str:
    p = f"split_part(lower({u}), '?', 1)"
    parts = []
    for label, pats in P.page_types:
        cond = " OR ".join(f"contains({p}, {q(x)})" for x in pats)
        parts.append(f"WHEN {cond} THEN {q(label)}")
    return "(CASE " + " ".join(parts) + " ELSE 'unknown' END)"


def tier(s: str) -> str:
    return f"(CASE WHEN {s} >= {P.tier_high} THEN 'HIGH' WHEN {s} >= {P.tier_med} THEN 'MED' ELSE 'LOW' END)"


def text_stats_ctes(src: str, key: str, text: str, prefix: str) -> str:
    """CTEs ``{prefix}_st(key, ...)`` with the raw text counts."""
    return f"""
{prefix}_b AS (SELECT {key} AS k, coalesce({text}, '') AS t FROM {src} WHERE {key} IS NOT NULL),
{prefix}_w AS (SELECT k, t, {tokens('t')} AS w FROM {prefix}_b),
{prefix}_i AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM {prefix}_w),
{prefix}_words AS (SELECT k, i - 1 AS pos, w[i] AS wd, lower(w[i]) AS lw, w[i + 1] AS nx FROM {prefix}_i),
{prefix}_pw AS (
  SELECT k, count(*) AS word_count,
         sum(CASE WHEN regexp_matches(lw, '[a-z]') THEN 1 ELSE 0 END) AS r_words,
         sum(CASE WHEN regexp_matches(lw, '[a-z]') THEN greatest(1, len(regexp_extract_all(lw, '[aeiouy]+'))
               - CASE WHEN regexp_matches(lw, '[^l]e$') THEN 1 ELSE 0 END) ELSE 0 END) AS syllables
  FROM {prefix}_words GROUP BY k),
{prefix}_lc AS (SELECT k, lw, count(*) AS c, min(pos) AS first FROM {prefix}_words WHERE length(wd) > 4 GROUP BY k, lw),
{prefix}_top AS (SELECT k, sum(c) AS n_long, arg_max(lw, c * 4294967296 + (2147483647 - first)) AS top_word,
                        max(c) AS top_n FROM {prefix}_lc GROUP BY k),
{prefix}_bg AS (SELECT k, wd, nx, count(*) AS c FROM {prefix}_words WHERE nx IS NOT NULL GROUP BY k, wd, nx),
{prefix}_rep AS (SELECT k, sum(CASE WHEN c > 3 THEN 1 ELSE 0 END) AS rep_bigrams FROM {prefix}_bg GROUP BY k),
{prefix}_pc AS (SELECT k, unnest(regexp_split_to_array(t, '[.!?]+')) AS s FROM {prefix}_b),
{prefix}_ps AS (SELECT k, {strip('s')} AS ss FROM {prefix}_pc),
{prefix}_sn AS (SELECT k, count(*) AS n_sent, sum(len(regexp_split_to_array(ss, '{WS}+'))) AS s1,
                       sum(len(regexp_split_to_array(ss, '{WS}+')) * len(regexp_split_to_array(ss, '{WS}+'))) AS s2
                FROM {prefix}_ps WHERE length(ss) > 5 GROUP BY k),
{prefix}_st AS (
  SELECT b.k,
         coalesce(pw.word_count, 0) AS word_count, coalesce(tp.n_long, 0) AS n_long, tp.top_word,
         coalesce(tp.top_n, 0) AS top_n, coalesce(rp.rep_bigrams, 0) AS rep_bigrams,
         coalesce(pw.r_words, 0) AS r_words, coalesce(pw.syllables, 0) AS syllables,
         coalesce(sn.n_sent, 0)::BIGINT AS n_sent, coalesce(sn.s1, 0)::BIGINT AS s1, coalesce(sn.s2, 0)::BIGINT AS s2,
         {contained('lower(b.t)', P.ai_phrases)} AS slop,
         {contained('lower(b.t)', P.discussion_markers)} AS disc,
         length({strip('b.t')}) AS strip_len
  FROM {prefix}_b b LEFT JOIN {prefix}_pw pw USING (k) LEFT JOIN {prefix}_top tp USING (k)
       LEFT JOIN {prefix}_rep rp USING (k) LEFT JOIN {prefix}_sn sn USING (k)),
{prefix}_f AS (
  SELECT *,
    CASE WHEN n_sent > 5 THEN sqrt((n_sent * s2 - s1 * s1)::DOUBLE / (n_sent * (n_sent - 1))::DOUBLE)
         / (s1::DOUBLE / n_sent::DOUBLE) END AS cv,
    CASE WHEN r_words > 0 THEN r_words::DOUBLE / greatest(n_sent, 1)::DOUBLE ELSE 0.0 END AS wps,
    CASE WHEN r_words > 0 THEN syllables::DOUBLE / r_words::DOUBLE ELSE 0.0 END AS spw,
    CASE WHEN n_long > 0 THEN top_n::DOUBLE / n_long::DOUBLE END AS kw_ratio,
    CASE WHEN word_count > 20 THEN rep_bigrams::DOUBLE / greatest(word_count - 1, 1)::DOUBLE END AS rep_ratio
  FROM {prefix}_st),
{prefix}_g AS (
  SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * wps - 84.6::DOUBLE * spw AS flesch,
            0.39::DOUBLE * wps + 11.8::DOUBLE * spw - 15.59::DOUBLE AS grade
  FROM {prefix}_f),
{prefix}_ts AS (
  SELECT *,
    (CASE WHEN flesch < 10 THEN -5 WHEN flesch >= 30 AND flesch <= 70 THEN 5 ELSE 0 END)
    + (CASE WHEN word_count < 100 THEN -25 WHEN word_count < 200 THEN -10 WHEN word_count > 500 THEN 5 ELSE 0 END)
    + (CASE WHEN kw_ratio > 0.05 THEN -10 ELSE 0 END) + (CASE WHEN rep_ratio > 0.05 THEN -10 ELSE 0 END)
    + (CASE WHEN cv < 0.3 THEN -5 ELSE 0 END)
    + (CASE WHEN slop >= 3 THEN -15 WHEN slop >= 1 THEN -3 ELSE 0 END)
    + (CASE WHEN disc >= 2 THEN 10 ELSE 0 END) AS t_points,
    list_filter([
      CASE WHEN flesch < 10 THEN 'very_hard_to_read' END,
      CASE WHEN word_count < 100 THEN 'thin' WHEN word_count < 200 THEN 'short' END,
      CASE WHEN kw_ratio > 0.05 THEN 'keyword_stuffing:' || top_word END,
      CASE WHEN rep_ratio > 0.05 THEN 'repetitive' END,
      CASE WHEN cv < 0.3 THEN 'uniform_sentences' END,
      CASE WHEN slop >= 3 THEN 'slop_phrases:' || slop::VARCHAR END,
      CASE WHEN disc >= 2 THEN 'discussion' END], lambda x: x IS NOT NULL) AS t_flags
  FROM {prefix}_g)"""


def html_ctes(src: str, key: str, html: str, content: str, prefix: str) -> str:
    hl = f"lower({html})"
    return f"""
{prefix}_h0 AS (
  SELECT {key} AS k, {html} AS html,
    len(regexp_extract_all({hl}, '<code[\\s>]')) + len(regexp_extract_all({hl}, '<pre[\\s>]')) AS code_blocks,
    contains({hl}, '<article') AS article,
    len(regexp_extract_all({hl}, 'class="[^"]*comment[^"]*"')) AS comments,
    len(regexp_extract_all({hl}, '<a[\\s>]')) AS links,
    len(regexp_extract_all({hl}, '<a[\\s>]'))::DOUBLE / (greatest(coalesce(length({content}), 0), 1)::DOUBLE / 100.0) AS density,
    coalesce(list_sum(list_transform(regexp_extract_all({hl}, '(?s)<nav[\\s>].*?</nav>'), lambda x: length(x))), 0) AS nav_len,
    {contained(hl, P.ad_trackers)} AS ad_scripts
  FROM {src}),
{prefix}_h AS (
  SELECT *,
    nav_len::DOUBLE / greatest(length(html), 1)::DOUBLE AS nav_ratio_raw,
    (CASE WHEN code_blocks >= 2 THEN 10 WHEN code_blocks = 1 THEN 5 ELSE 0 END)
    + (CASE WHEN article THEN 3 ELSE 0 END) + (CASE WHEN comments >= 3 THEN 5 ELSE 0 END)
    + (CASE WHEN density > 3.0 THEN -10 WHEN density > 2.0 THEN -5 ELSE 0 END)
    + (CASE WHEN nav_len > 0 AND nav_len::DOUBLE / greatest(length(html), 1)::DOUBLE > 0.3 THEN -5 ELSE 0 END)
    + (CASE WHEN ad_scripts >= 4 THEN -5 ELSE 0 END) AS h_points,
    list_filter([
      CASE WHEN code_blocks >= 1 THEN 'has_code' END,
      CASE WHEN article THEN 'has_article_tag' END,
      CASE WHEN comments >= 3 THEN 'has_comments' END,
      CASE WHEN density > 3.0 THEN 'high_link_density' END,
      CASE WHEN nav_len > 0 AND nav_len::DOUBLE / greatest(length(html), 1)::DOUBLE > 0.3 THEN 'nav_heavy' END,
      CASE WHEN ad_scripts >= 4 THEN 'ad_heavy' END], lambda x: x IS NOT NULL) AS h_flags
  FROM {prefix}_h0)"""


def domain_ctes(src: str, key: str, url: str, prefix: str) -> str:
    sfx = lst(P.public_suffixes)
    host = (f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace({url}, "
            f"'^\\s*([A-Za-z0-9+.-]+:)?//', ''), '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*\\z', ''), '\\.+\\z', ''))")
    return f"""
{prefix}_d0 AS (SELECT {key} AS k, {url} AS url, {host} AS host FROM {src}),
{prefix}_d1 AS (SELECT *, string_split(host, '.') AS labels, len(string_split(host, '.')) AS n FROM {prefix}_d0),
{prefix}_d2 AS (
  SELECT *, CASE WHEN host = '' OR regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+\\z') OR contains(host, ':') THEN 0
                 WHEN n >= 2 AND array_to_string(labels[n - 1:n], '.') IN (SELECT unnest({sfx})) THEN 2
                 WHEN n >= 1 AND labels[n] IN (SELECT unnest({sfx})) THEN 1 ELSE 0 END AS kk
  FROM {prefix}_d1),
{prefix}_d3 AS (
  SELECT *, CASE WHEN kk > 0 THEN array_to_string(labels[n - kk + 1:n], '.') ELSE '' END AS suffix,
            CASE WHEN kk > 0 AND n > kk THEN labels[n - kk] ELSE '' END AS name
  FROM {prefix}_d2),
{prefix}_d4 AS (
  SELECT *, CASE WHEN name <> '' AND suffix <> '' THEN name || '.' || suffix ELSE '' END AS domain,
         list_sort(list_intersect(list_distinct(string_split(lower(name), '-')), {lst(P.seo_keywords)})) AS seo
  FROM {prefix}_d3),
{prefix}_d AS (
  SELECT *,
    CASE WHEN domain = '' THEN 0 ELSE
      (CASE WHEN suffix IN (SELECT unnest({lst(P.high_quality_tlds)})) THEN 5
            WHEN suffix IN (SELECT unnest({lst(P.low_quality_tlds)})) THEN -10 ELSE 0 END)
      + (CASE WHEN length(name) - length(replace(name, '-', '')) >= 3 THEN -10 ELSE 0 END)
      + (CASE WHEN length(name) > 30 THEN -5 ELSE 0 END)
      + (CASE WHEN regexp_matches(name, '20[2-3][0-9]') THEN -8 ELSE 0 END)
      + (CASE WHEN len(seo) > 0 THEN -8 ELSE 0 END) END AS d_points,
    CASE WHEN domain = '' THEN ['bad_url'] ELSE list_filter([
      CASE WHEN suffix IN (SELECT unnest({lst(P.high_quality_tlds)})) THEN 'institutional_tld'
           WHEN suffix IN (SELECT unnest({lst(P.low_quality_tlds)})) THEN 'junk_tld' END,
      CASE WHEN length(name) - length(replace(name, '-', '')) >= 3 THEN 'hyphen_stuffed' END,
      CASE WHEN length(name) > 30 THEN 'long_domain' END,
      CASE WHEN regexp_matches(name, '20[2-3][0-9]') THEN 'year_in_domain' END,
      CASE WHEN len(seo) > 0 THEN 'seo_domain:' || array_to_string(seo, ',') END], lambda x: x IS NOT NULL) END AS d_flags
  FROM {prefix}_d4)"""


def results_view_cte() -> str:
    return r"""
rv AS (
  SELECT 'lang:' || coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/]+/([a-z]{2})/', 1), ''), 'none') AS query,
         coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INTEGER), 1) AS page,
         page_id AS pos, url, page_id FROM pages
  UNION ALL
  SELECT 'site:' || regexp_extract(url, '^[A-Za-z]+://([^./]+)\.', 1), 1, page_id, url, page_id FROM pages),""" + f"""
cl0 AS (SELECT *, {canonical('url')} AS canon FROM rv),
cl1 AS (SELECT *, {url_ext('canon')} AS ext, {url_host('canon')} AS host FROM cl0),
cl AS (
  SELECT *, CASE WHEN ext IN (SELECT unnest({lst(P.skip_extensions)})) THEN 'ext'
                 WHEN list_has_any({host_suffixes('host')}, {lst([d.lower() for d in P.custom_blocked])}) THEN 'blocked'
            END AS drop_reason
  FROM cl1),"""


def search_ctes(limit: int) -> str:
    return results_view_cte() + f"""
c0 AS (SELECT *, page::HUGEINT * 18446744073709551616 + pos::HUGEINT AS ord FROM cl),
fs AS (SELECT query, canon, min(ord) AS f FROM c0 WHERE drop_reason IS NULL GROUP BY query, canon),
c2 AS (SELECT c0.*, (c0.drop_reason IS NULL AND c0.ord = fs.f) AS is_new
       FROM c0 LEFT JOIN fs ON c0.query = fs.query AND c0.canon = fs.canon),
pp AS (SELECT query, page, count_if(coalesce(drop_reason IS NOT NULL, false)) AS filtered,
              count_if(coalesce(drop_reason IS NULL AND is_new, false)) AS kept_new FROM c2 GROUP BY query, page),
ct AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY page) AS rn,
              sum(kept_new) OVER (PARTITION BY query ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
       FROM pp),
ct2 AS (SELECT *, coalesce(min(CASE WHEN filtered > 0 AND cum < {limit} THEN 1 ELSE 0 END)
                  OVER (PARTITION BY query ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS go_before
        FROM ct),
used_pages AS (SELECT query, page, filtered, kept_new FROM ct2 WHERE rn = page AND go_before AND page <= {P.max_pages}),
used AS (SELECT c2.* FROM c2 JOIN used_pages up ON c2.query = up.query AND c2.page = up.page WHERE c2.is_new),
sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY page, pos) AS rank FROM used)
       WHERE rank <= {limit}),"""


def entries_ctes() -> str:
    """Documents as session entries, with their text score."""
    return "WITH " + text_stats_ctes("documents", "doc_id", "text", "x") + f""",
de AS (
  SELECT d.source AS session, d.doc_id AS ord, regexp_extract(d.text, '^([^\\n]*)', 1) AS title,
         'https://' || d.source || '.example.org/doc/' || d.doc_id::VARCHAR AS url, d.text AS content,
         d.text AS snippet, NULL::VARCHAR AS query, NULL::VARCHAR AS error,
         CASE WHEN d.text IS NULL OR x.strip_len < {P.min_text} THEN 0
              ELSE least(100, greatest(0, {P.baseline} + x.t_points)) END AS score,
         0.0::DOUBLE AS relevance, 'unknown' AS page_type
  FROM documents d JOIN x_ts x ON d.doc_id = x.k),
ds AS (SELECT source AS session, source AS query, [source] AS queries, count(*)::BIGINT AS total,
              0::BIGINT AS dedup_removed FROM documents GROUP BY source)"""


def py_float3(e: str) -> str:
    s = f"regexp_replace(printf('%.3f', {e}), '0+\\z', '')"
    return f"(CASE WHEN {e} IS NULL THEN '0.0' ELSE regexp_replace({s}, '\\.\\z', '.0') END)"


# --------------------------------------------------------------------------

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["url_projections"] = f"""
WITH a AS (SELECT page_id, url, {canonical('url')} AS canon FROM pages),
b AS (SELECT *, {url_host('canon')} AS host FROM a)
SELECT page_id, canon, {url_ext('canon')} AS ext, host,
       len({host_suffixes('host')})::BIGINT AS n_suffixes, array_to_string({host_suffixes('host')}, '|') AS suffixes,
       CASE WHEN instr(url, '//') > 0 THEN split_part(split_part(url, '//', 2), '/', 1) ELSE '' END AS listing_host,
       {page_type('url')} AS page_type,
       replace(url, 'reddit.com', 'old.reddit.com') AS fetch_url,
       coalesce(regexp_matches(url, '^https?://(www\\.)?(youtube\\.com|youtu\\.be)/'), false) AS is_video,
       nullif(regexp_extract(url, '(?:v=|youtu\\.be/)([\\w-]{{11}})', 1), '') AS video_id
FROM b"""

ORACLE_SQL["result_filter_counts"] = "WITH " + results_view_cte().rstrip(",") + """
SELECT query, count(*)::BIGINT AS total, count_if(coalesce(drop_reason = 'ext', false))::BIGINT AS skipped_ext,
       count_if(coalesce(drop_reason = 'blocked', false))::BIGINT AS skipped_blocked, count_if(coalesce(drop_reason IS NULL, false))::BIGINT AS kept
FROM cl GROUP BY query"""

ORACLE_SQL["page_budget"] = "WITH " + search_ctes(P.cli_limit).rstrip(",") + """
SELECT query, page::BIGINT AS page, filtered::BIGINT AS filtered, kept_new::BIGINT AS kept_new FROM used_pages"""

ORACLE_SQL["search_results"] = "WITH " + search_ctes(P.cli_limit).rstrip(",") + """
SELECT query, page::BIGINT AS page, pos::BIGINT AS pos, canon, rank::BIGINT AS rank FROM sr"""

ORACLE_SQL["cross_query_dedup"] = "WITH " + search_ctes(P.cli_limit) + """
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY query, page, pos) AS r1 FROM sr) WHERE r1 = 1)
SELECT query, pos::BIGINT AS pos, canon FROM u"""

ORACLE_SQL["query_result_counts"] = "WITH " + search_ctes(P.cli_limit) + """
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY query, page, pos) AS r1 FROM sr) WHERE r1 = 1)
SELECT sr.query, count(*)::BIGINT AS results, count(u.canon)::BIGINT AS unique_after_cross,
       (count(*) - count(u.canon))::BIGINT AS dupes
FROM sr LEFT JOIN u ON sr.query = u.query AND sr.canon = u.canon GROUP BY sr.query"""

ORACLE_SQL["first_seen_events"] = """
SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"""

ORACLE_SQL["extract_text"] = f"""
SELECT page_id, {extract_text('html')} AS content, length({extract_text('html')})::BIGINT AS content_len FROM pages"""

ORACLE_SQL["page_title"] = f"SELECT page_id, {page_title('html')} AS title FROM pages"

ORACLE_SQL["html_markdown"] = f"SELECT page_id, {html_to_markdown('html')} AS markdown FROM pages"

_PAGES_C = f"pc AS (SELECT page_id, url, html, {extract_text('html')} AS content FROM pages)"

ORACLE_SQL["html_signals"] = f"WITH {_PAGES_C}," + html_ctes("pc", "page_id", "html", "content", "y") + """
SELECT k AS page_id, h_points::BIGINT AS points, array_to_string(h_flags, ',') AS flags,
       code_blocks::BIGINT AS code_blocks, links::BIGINT AS links, round(density, 6) AS link_density,
       nav_len::BIGINT AS nav_len, CASE WHEN nav_len > 0 THEN round(nav_ratio_raw, 3) END AS nav_ratio,
       ad_scripts::BIGINT AS ad_scripts
FROM y_h WHERE length(html) > 0
UNION ALL  -- a page without html has no signals
SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pc WHERE coalesce(length(html), 0) = 0"""

ORACLE_SQL["domain_signals"] = "WITH " + domain_ctes("pages", "page_id", "url", "z") + """
SELECT k AS page_id, domain, name, suffix, d_points::BIGINT AS points, array_to_string(d_flags, ',') AS flags FROM z_d"""

_PAGE_SCORE = (f"WITH {_PAGES_C}," + text_stats_ctes("pc", "page_id", "content", "x") + ","
               + html_ctes("pc", "page_id", "html", "content", "y") + ","
               + domain_ctes("pc", "page_id", "url", "z") + f""",
ps AS (
  SELECT pc.page_id, pc.url, pc.html, pc.content,
    CASE WHEN pc.content IS NULL OR x.strip_len < {P.min_text} THEN 0
         ELSE least(100, greatest(0, {P.baseline} + (CASE WHEN coalesce(length(pc.url), 0) > 0 THEN z.d_points ELSE 0 END)
              + (CASE WHEN coalesce(length(pc.html), 0) > 0 THEN y.h_points ELSE 0 END) + x.t_points)) END AS score,
    CASE WHEN pc.content IS NULL OR x.strip_len < {P.min_text} THEN ['empty']
         ELSE list_concat(list_concat(CASE WHEN coalesce(length(pc.url), 0) > 0 THEN z.d_flags ELSE []::VARCHAR[] END,
                          CASE WHEN coalesce(length(pc.html), 0) > 0 THEN y.h_flags ELSE []::VARCHAR[] END), x.t_flags) END AS flags,
    CASE WHEN pc.content IS NULL OR x.strip_len < {P.min_text} OR coalesce(length(pc.url), 0) = 0 THEN 'unknown'
         ELSE {page_type('pc.url')} END AS page_type,
    0.0::DOUBLE AS relevance
  FROM pc JOIN x_ts x ON pc.page_id = x.k JOIN y_h y ON pc.page_id = y.k JOIN z_d z ON pc.page_id = z.k)""")

ORACLE_SQL["page_score"] = _PAGE_SCORE + f"""
SELECT page_id, score::BIGINT AS score, array_to_string(flags, ',') AS flags, page_type, relevance,
       {tier('score')} AS tier FROM ps"""

ORACLE_SQL["page_outcome"] = f"""
WITH o AS (SELECT page_id, url, html,
  CASE WHEN coalesce(regexp_matches(url, '^https?://(www\\.)?(youtube\\.com|youtu\\.be)/'), false) THEN NULL
       WHEN coalesce(length(html), 0) > 0 THEN {extract_text('html')} END AS content,
  coalesce(regexp_matches(url, '^https?://(www\\.)?(youtube\\.com|youtu\\.be)/'), false) AS video,
  coalesce(length(html), 0) > 0 AS success FROM pages)
SELECT page_id,
  CASE WHEN video THEN (CASE WHEN content IS NOT NULL THEN 'scraped' ELSE 'error' END)
       WHEN coalesce(length(content), 0) > {P.min_text} THEN 'scraped' WHEN NOT success THEN 'error' ELSE 'none' END AS outcome,
  CASE WHEN video AND content IS NULL THEN 'No transcript available' END AS error,
  length(content)::BIGINT AS content_len
FROM o"""

ORACLE_SQL["scrape_log"] = f"""
WITH o AS (SELECT page_id,
  coalesce(regexp_matches(url, '^https?://(www\\.)?(youtube\\.com|youtu\\.be)/'), false) AS video,
  coalesce(length(html), 0) > 0 AS success,
  CASE WHEN coalesce(length(html), 0) > 0 THEN {extract_text('html')} END AS content FROM pages),
o2 AS (SELECT *, CASE WHEN video THEN (CASE WHEN false THEN 'scraped' ELSE 'error' END)
                      WHEN coalesce(length(content), 0) > {P.min_text} THEN 'scraped'
                      WHEN NOT success THEN 'error' ELSE 'none' END AS outcome FROM o)
SELECT 0::BIGINT AS blocked, count_if(coalesce(outcome = 'scraped', false))::BIGINT AS scraped,
       count_if(coalesce(outcome = 'error', false))::BIGINT AS errors, count(*)::BIGINT AS total FROM o2"""

_PAGE_ENTRIES = _PAGE_SCORE + """,
pe AS (
  SELECT 'lang:' || coalesce(nullif(regexp_extract(ps.url, '^[A-Za-z]+://[^/]+/([a-z]{2})/', 1), ''), 'none') AS session,
         ps.page_id AS ord, """ + page_title("ps.html") + """ AS title, ps.url, ps.content, ps.html,
         ps.score, ps.relevance, ps.page_type, ps.flags
  FROM ps)"""

ORACLE_SQL["page_listing"] = _PAGE_ENTRIES + f"""
SELECT session, ord::BIGINT AS ord, {tier('score')} AS tier, score::VARCHAR AS score_text,
       printf('%.2f', coalesce(relevance, 0.0)) AS rel,
       CASE WHEN instr(coalesce(url, ''), '//') > 0 THEN split_part(split_part(url, '//', 2), '/', 1) ELSE '' END AS host,
       substr(coalesce(title, 'Untitled'), 1, 60) AS title60
FROM pe WHERE coalesce(length(content), 0) >= {P.min_text}"""

ORACLE_SQL["page_view"] = _PAGE_ENTRIES + f"""
SELECT session, ord::BIGINT AS ord,
  concat_ws({NL} || {NL}, '# ' || coalesce(title, 'Untitled'), coalesce(url, ''),
            'quality: ' || coalesce(score::VARCHAR, '?') || '/100 | relevance: ' || {py_float3('relevance')}
            || ' | type: ' || coalesce(page_type, 'unknown'),
            CASE WHEN len(coalesce(flags, [])) > 0 THEN 'flags: ' || array_to_string(flags, ', ') END, '---') AS header,
  coalesce({html_to_markdown('html')}, nullif(content, ''), 'No content extracted.') AS body
FROM pe"""

ORACLE_SQL["text_signals"] = "WITH " + text_stats_ctes("documents", "doc_id", "text", "x") + """
SELECT k AS doc_id, t_points::BIGINT AS points, array_to_string(t_flags, ',') AS flags, word_count::BIGINT AS word_count,
       top_word, round(kw_ratio, 6) AS top_ratio, rep_bigrams::BIGINT AS repeated_bigrams, round(rep_ratio, 6) AS bigram_ratio,
       n_sent::BIGINT AS sentences, round(cv, 6) AS sentence_cv, slop::BIGINT AS slop_phrases,
       disc::BIGINT AS discussion_markers, r_words::BIGINT AS readability_words, syllables::BIGINT AS syllables,
       round(flesch, 6) AS flesch, round(grade, 6) AS grade
FROM x_ts"""

ORACLE_SQL["document_score"] = "WITH " + text_stats_ctes("documents", "doc_id", "text", "x") + f""",
s AS (SELECT d.doc_id, CASE WHEN d.text IS NULL OR x.strip_len < {P.min_text} THEN 0
                            ELSE least(100, greatest(0, {P.baseline} + x.t_points)) END AS score,
             CASE WHEN d.text IS NULL OR x.strip_len < {P.min_text} THEN ['empty'] ELSE x.t_flags END AS flags
      FROM documents d JOIN x_ts x ON d.doc_id = x.k)
SELECT doc_id, score::BIGINT AS score, array_to_string(flags, ',') AS flags, {tier('score')} AS tier FROM s"""

ORACLE_SQL["query_score"] = "WITH " + text_stats_ctes("documents", "doc_id", "text", "x") + f""",
d AS (SELECT doc_id, text, regexp_extract(text, '^([^\\n]*)', 1) AS query, doc_id % 40 AS h, doc_id % 11 = 0 AS ai FROM documents),
ranks AS (SELECT h, (10 ** (min(doc_id) % 7))::BIGINT AS r FROM d GROUP BY h),
tx AS (SELECT 'q' AS kind, doc_id AS id, query AS text FROM d UNION ALL SELECT 't', doc_id, text FROM d),
n AS (SELECT count(*) AS n FROM tx),
tf AS (SELECT kind, id, term, count(*) AS tf FROM (SELECT kind, id, unnest({tokens('lower(text)')}) AS term FROM tx) GROUP BY ALL),
idf AS (SELECT term, ln((n.n + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM tf, n GROUP BY term, n.n),
w AS (SELECT kind, id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term),
nm AS (SELECT kind, id, sqrt(sum(w * w)) AS norm FROM w GROUP BY kind, id),
dots AS (SELECT a.id, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.id = b.id AND a.term = b.term WHERE a.kind = 'q' AND b.kind = 't' GROUP BY a.id),
rel AS (SELECT d.doc_id, CASE WHEN p.norm > 0 AND t.norm > 0 THEN least(1.0, greatest(0.0, coalesce(dots.dot, 0.0) / (p.norm * t.norm))) ELSE 0.0 END AS rel
        FROM d LEFT JOIN dots ON dots.id = d.doc_id LEFT JOIN nm p ON p.kind = 'q' AND p.id = d.doc_id LEFT JOIN nm t ON t.kind = 't' AND t.id = d.doc_id),
j AS (SELECT d.doc_id, d.text, x.strip_len, x.word_count, x.t_flags, d.ai, ranks.r, coalesce(length(d.query), 0) > 0 AS has_query,
             CASE WHEN coalesce(length(d.query), 0) > 0 THEN rel.rel ELSE 0.0 END AS rel,
             x.t_points + CASE WHEN d.ai THEN {P.ai_penalty} ELSE 0 END
             + CASE WHEN r <= 1000 THEN 15 WHEN r <= 10000 THEN 10 WHEN r <= 100000 THEN 5 ELSE 2 END AS points
      FROM d JOIN x_ts x ON d.doc_id = x.k JOIN ranks ON ranks.h = d.h JOIN rel ON rel.doc_id = d.doc_id),
s AS (SELECT *, text IS NULL OR strip_len < {P.min_text} AS nothing, has_query AND rel < {P.off_topic} AND word_count > 200 AS off,
             CASE WHEN NOT has_query THEN 0 WHEN rel >= {P.high_relevance} THEN 15 WHEN rel >= {P.moderate_relevance} THEN 8
                  WHEN rel < {P.low_relevance} AND word_count > 200 THEN -15 ELSE 0 END AS r_points,
             CASE WHEN NOT ai THEN t_flags WHEN t_flags[1] = 'very_hard_to_read' THEN list_concat(['very_hard_to_read', 'likely_ai'], t_flags[2:])
                  ELSE list_concat(['likely_ai'], t_flags) END AS x_flags FROM j),
f AS (SELECT doc_id, CASE WHEN nothing OR off THEN 0 ELSE least(100, greatest(0, {P.baseline} + points + r_points)) END AS score,
             CASE WHEN nothing THEN ['empty'] ELSE list_filter(list_concat(list_concat(
               [CASE WHEN r <= 1000 THEN 'top_1k' WHEN r <= 10000 THEN 'top_10k' WHEN r <= 100000 THEN 'top_100k' END], x_flags),
               [CASE WHEN off THEN 'off_topic' WHEN NOT has_query THEN NULL WHEN rel >= {P.high_relevance} THEN 'highly_relevant'
                     WHEN rel >= {P.moderate_relevance} THEN 'relevant'
                     WHEN rel < {P.low_relevance} AND word_count > 200 THEN 'low_relevance' END]), lambda x: x IS NOT NULL) END AS flags,
             CASE WHEN nothing THEN 0.0 ELSE round(rel, 3) END AS relevance FROM s)
SELECT doc_id, score::BIGINT AS score, array_to_string(flags, ',') AS flags, relevance::DOUBLE AS relevance, {tier('score')} AS tier FROM f"""

ORACLE_SQL["session_stats"] = entries_ctes() + f"""
SELECT session, count(*)::BIGINT AS total,
  count_if(coalesce(length(content), 0) > {P.min_length} AND coalesce(score, 50) >= {P.min_score})::BIGINT AS usable,
  count_if(coalesce(length(content), 0) > {P.min_length} AND coalesce(score, 50) < {P.min_score})::BIGINT AS filtered,
  sum(CASE WHEN coalesce(length(content), 0) > {P.min_length} AND coalesce(score, 50) >= {P.min_score}
           THEN least(length(content), {P.max_chars}) ELSE 0 END)::BIGINT AS chars,
  floor(sum(CASE WHEN coalesce(length(content), 0) > {P.min_length} AND coalesce(score, 50) >= {P.min_score}
           THEN least(length(content), {P.max_chars}) ELSE 0 END) / {P.tokens_per_char})::BIGINT AS tokens
FROM de GROUP BY session"""

ORACLE_SQL["run_summary"] = entries_ctes() + f""",
a AS (SELECT session, sum(CASE WHEN coalesce(length(content), 0) > {P.min_text} THEN length(content) ELSE 0 END)::BIGINT AS chars,
             count_if(coalesce(length(content), 0) > {P.min_text})::BIGINT AS scraped,
             count_if(coalesce(error IS NOT NULL, false))::BIGINT AS errors FROM de GROUP BY session)
SELECT session, chars, (chars // {P.tokens_per_char})::BIGINT AS tokens, scraped, 0::BIGINT AS blocked, errors,
  CASE WHEN errors > 0 THEN 'warn' ELSE 'done' END AS level,
  concat_ws(', ', scraped::VARCHAR || ' scraped', CASE WHEN errors > 0 THEN errors::VARCHAR || ' errors' END,
            '~' || format('{{:,}}', (chars // {P.tokens_per_char})::BIGINT) || ' tokens') AS message
FROM a"""

ORACLE_SQL["session_listing"] = entries_ctes() + f""",
a AS (SELECT session, count_if(coalesce(length(content), 0) > {P.min_text})::BIGINT AS pages, count(*)::BIGINT AS total,
             sum(CASE WHEN coalesce(length(content), 0) > {P.min_text} THEN length(content) ELSE 0 END)::BIGINT AS chars
      FROM de GROUP BY session)
SELECT ds.session, substr(ds.query, 1, 80) AS query_80, a.pages, a.total, (a.chars // {P.tokens_per_char})::BIGINT AS tokens,
       ds.session || '  |  ' || a.pages::VARCHAR || ' pages  |  ' || substr(ds.query, 1, 80) AS line
FROM ds LEFT JOIN a ON ds.session = a.session"""

ORACLE_SQL["digest_parts"] = entries_ctes() + f""",
u AS (SELECT *, coalesce(score, 50)::DOUBLE * greatest(coalesce(relevance, 0.5), 0.1) AS sort_key
      FROM de WHERE coalesce(length(content), 0) >= {P.min_length} AND coalesce(score, 50) >= {P.min_score}),
uc AS (SELECT session, count(*) AS usable FROM u GROUP BY session),
h AS (SELECT ds.*, coalesce(uc.usable, 0) AS usable FROM ds LEFT JOIN uc ON ds.session = uc.session),
parts AS (
  SELECT session, 0 AS block, NULL::DOUBLE AS sort_key, NULL::BIGINT AS ord, 0 AS part_no, '# Research: ' || query AS part FROM h
  UNION ALL
  SELECT session, 0, NULL, NULL, 1,
    '_Scored and ranked by content quality. ' || concat_ws(', ', usable::VARCHAR || ' sources',
      CASE WHEN total - usable > 0 THEN (total - usable)::VARCHAR || ' low-quality filtered out' END,
      CASE WHEN dedup_removed > 0 THEN dedup_removed::VARCHAR || ' near-duplicates removed' END) || '._' || {NL}
  FROM h
  UNION ALL
  SELECT session, 1, sort_key, ord, 0, '## [' || {tier('coalesce(score, 50)')} || '] ' || coalesce(title, '') FROM u
  UNION ALL
  SELECT session, 1, sort_key, ord, 1, 'quality: ' || coalesce(score, 50)::VARCHAR || '/100 | relevance: '
         || {py_float3('relevance')} || ' | type: ' || coalesce(page_type, 'unknown') FROM u
  UNION ALL
  SELECT session, 1, sort_key, ord, 2, CASE WHEN length(content) > {P.max_chars}
         THEN substr(content, 1, {P.max_chars}) || {q(P.truncation_marker).replace(chr(10), "' || chr(10) || '")} ELSE content END FROM u
  UNION ALL
  SELECT session, 1, sort_key, ord, 3, '' FROM u)
SELECT session, block::BIGINT AS block, round(sort_key, 6) AS sort_key, ord, part_no::BIGINT AS part_no, part FROM parts"""

ORACLE_SQL["snippet_view"] = entries_ctes() + """
SELECT session, ord::BIGINT AS ord,
       '### ' || (row_number() OVER (PARTITION BY session ORDER BY ord))::VARCHAR || '. ' || coalesce(title, '') AS heading,
       coalesce(url, '') AS url, coalesce(snippet, '') AS snippet
FROM de"""

_PRE, _REST = P.prompt_template.split("{query}")
_MID, _POST = _REST.split("{content}")


def _sql_text(s: str) -> str:
    return " || ".join(q(part) if part else "''" for part in s.split("\n")).replace("' || '", "' || chr(10) || '") \
        if "\n" in s else q(s)


ORACLE_SQL["prompt_rows"] = entries_ctes() + f"""
SELECT de.session, de.ord::BIGINT AS ord,
  {_sql_text(_PRE)} || coalesce(de.query, array_to_string(ds.queries, ' '), '') || {_sql_text(_MID)}
  || substr(de.content, 1, {P.llm_max_input_chars}) || {_sql_text(_POST)} AS prompt
FROM de LEFT JOIN ds ON de.session = ds.session
WHERE coalesce(length(de.content), 0) > {P.min_text}"""


def slugify(e: str) -> str:
    return f"substr(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9]+', '-', 'g'), '^-+|-+\\z', '', 'g'), 1, {P.max_slug_length})"


ORACLE_SQL["slug_names"] = f"""
WITH ds AS (SELECT source AS session, source AS query, [source] AS queries FROM documents GROUP BY source)
SELECT session, {slugify('query')} AS slug,
       'search-' || {slugify("array_to_string(queries, ' ')")} || '.json' AS file_name,
       coalesce(array_to_string(queries, ', '), '') AS display_query
FROM ds"""

_SHINGLE_TEXT = f"regexp_replace(lower(coalesce(text, '')), '^{WS}+|{WS}+\\z', '', 'g')"

ORACLE_SQL["exact_duplicates"] = f"""
WITH d AS (SELECT doc_id, sha256({_SHINGLE_TEXT}) AS h,
                  {100 * (1 << 56) // 2}::BIGINT + doc_id AS p FROM documents WHERE length(text) >= {P.min_content_length}),
g AS (SELECT h, min(p) AS best, count(*)::BIGINT AS copies FROM d GROUP BY h)
SELECT d.doc_id, d.p = g.best AS exact_keep, g.copies FROM d JOIN g ON d.h = g.h"""

ORACLE_SQL["shingle_counts"] = f"""
WITH t AS (SELECT doc_id, {_SHINGLE_TEXT} AS s FROM documents),
c AS (SELECT doc_id, unnest(string_split(s, '')) AS ch, generate_subscripts(string_split(s, ''), 1) AS i
      FROM t WHERE length(s) >= {P.shingle_size}),
w AS (SELECT doc_id, ch{"".join(f" || lead(ch, {j}) OVER o" for j in range(1, P.shingle_size))} AS g
      FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(DISTINCT g)::BIGINT AS shingles FROM w GROUP BY doc_id
UNION ALL SELECT doc_id, 1::BIGINT FROM t WHERE length(s) < {P.shingle_size}"""


def _shingle_hash_sql(chars: str, k: int) -> str:
    h = "0::BIGINT"
    for j in range(k):
        h = f"(({h}) * {BASE} + unicode({chars}[i + {j}])) % {PRIME}"
    return h


def minhash_ctes(where: str) -> str:
    slots = P.lsh_bands * P.lsh_rows
    a, b = perm_coefficients(slots)
    perms = ", ".join(f"({i}, {a[i]}, {b[i]})" for i in range(slots))
    k = P.shingle_size
    return f"""
mt AS (SELECT doc_id, s, string_split(s, '') AS ch FROM (SELECT doc_id, {_SHINGLE_TEXT} AS s FROM documents WHERE {where})),
sh AS (SELECT DISTINCT doc_id, {_shingle_hash_sql('ch', k)} AS h
       FROM mt, range(1, greatest(length(s) - {k} + 2, 1)) r(i) WHERE length(s) >= {k}),
perm(pi, pa, pb) AS (VALUES {perms}),
sg AS (SELECT doc_id, pi, min((h * pa + pb) % {PRIME}) AS v FROM sh, perm GROUP BY doc_id, pi),
sig AS (SELECT doc_id, list(v ORDER BY pi) AS sig FROM sg GROUP BY doc_id)"""


ORACLE_SQL["minhash_signature"] = "WITH " + minhash_ctes(f"length(text) >= {P.min_content_length}") + """
SELECT doc_id, array_to_string(sig, ',') AS signature FROM sig"""

ORACLE_SQL["vector_relevance"] = """
WITH qv AS (SELECT label, arg_min(embedding, vec_id) AS qvec FROM embeddings GROUP BY label),
j AS (SELECT e.vec_id, e.label, e.embedding AS a, qv.qvec AS b FROM embeddings e LEFT JOIN qv ON e.label = qv.label),
c AS (SELECT vec_id, label,
        list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE * b[i]::DOUBLE)) AS dot,
        sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) AS na,
        sqrt(list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE))) AS nb FROM j)
SELECT vec_id, label, round(CASE WHEN na = 0 OR nb = 0 OR na IS NULL OR nb IS NULL THEN 0.0
                                 ELSE least(1.0, greatest(0.0, dot / (na * nb))) END, 6) AS relevance FROM c"""

ORACLE_SQL["transcripts"] = f"""
SELECT conv_id, count(*)::BIGINT AS segments, (sum(length(coalesce(text, ''))) + count(*) - 1)::BIGINT AS chars,
       sum(len({tokens("coalesce(text, '')")}))::BIGINT AS words, min(turn)::BIGINT AS first_turn,
       max(turn)::BIGINT AS last_turn
FROM conversations GROUP BY conv_id"""

ORACLE_SQL["lexical_relevance"] = f"""
WITH t AS (SELECT {{'c': conv_id::BIGINT, 't': turn::BIGINT}} AS tid, text FROM conversations),
terms AS (SELECT tid, unnest({tokens('lower(text)')}) AS term FROM t),
tf AS (SELECT tid, term, count(*) AS tf FROM terms GROUP BY tid, term),
n AS (SELECT count(DISTINCT tid) AS n FROM t),
idf AS (SELECT term, ln((n.n + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM tf, n GROUP BY term, n.n),
w AS (SELECT tf.tid, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term),
nm AS (SELECT tid, sqrt(sum(w * w)) AS norm FROM w GROUP BY tid),
pairs AS (SELECT {{'c': conv_id::BIGINT, 't': turn::BIGINT - 1}} AS query_key, {{'c': conv_id::BIGINT, 't': turn::BIGINT}} AS text_key
          FROM conversations WHERE role = 'assistant'),
dots AS (SELECT p.query_key, p.text_key, sum(wl.w * wr.w) AS dot FROM pairs p
         JOIN w wl ON wl.tid = p.query_key JOIN w wr ON wr.tid = p.text_key AND wr.term = wl.term
         GROUP BY p.query_key, p.text_key)
SELECT p.text_key.c AS conv_id, p.query_key.t AS query_turn, p.text_key.t AS text_turn,
  round(CASE WHEN nl.norm > 0 AND nr.norm > 0 THEN least(1.0, greatest(0.0, coalesce(d.dot, 0.0) / (nl.norm * nr.norm)))
             ELSE 0.0 END, 6) AS relevance
FROM pairs p LEFT JOIN dots d ON p.query_key = d.query_key AND p.text_key = d.text_key
LEFT JOIN nm nl ON nl.tid = p.query_key LEFT JOIN nm nr ON nr.tid = p.text_key"""

ORACLE_SQL["sample_affinity"] = f"""
WITH sw AS (SELECT {tokens("lower(coalesce(text, ''))")} AS w FROM benchmark),
sg AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM sw)),
dw AS (SELECT doc_id, {tokens("lower(coalesce(text, ''))")} AS w FROM documents),
dg AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM dw)),
per AS (SELECT dg.doc_id, count(*)::BIGINT AS grams, count(sg.gram)::BIGINT AS covered
        FROM dg LEFT JOIN sg ON dg.gram = sg.gram GROUP BY dg.doc_id),
o AS (SELECT d.doc_id, coalesce(per.grams, 0)::BIGINT AS grams, coalesce(per.covered, 0)::BIGINT AS covered
      FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id)
SELECT doc_id, grams, covered, round(CASE WHEN grams > 0 THEN covered / grams ELSE 0.0 END, 6) AS affinity,
       (CASE WHEN (CASE WHEN grams > 0 THEN covered / grams ELSE 0.0 END) > {P.affinity_threshold} THEN 1.0 ELSE 0.0 END)::DOUBLE AS ai_score
FROM o"""


def _near_dup_sql() -> str:
    r = P.lsh_rows
    bands = ", ".join(f"hash({b}, sig[{b * r + 1}:{b * r + r}])" for b in range(P.lsh_bands))
    return ("WITH RECURSIVE " + text_stats_ctes("documents", "doc_id", "text", "x") + ","
            + minhash_ctes(f"length(text) >= {P.min_content_length}") + f""",
sc AS (SELECT d.doc_id, CASE WHEN d.text IS NULL OR x.strip_len < {P.min_text} THEN 0
                             ELSE least(100, greatest(0, {P.baseline} + x.t_points)) END AS score
       FROM documents d JOIN x_ts x ON d.doc_id = x.k),
ordered AS MATERIALIZED (
  SELECT s.doc_id, [{bands}] AS bks,
         row_number() OVER (ORDER BY (100 - sc.score)::BIGINT * {1 << 56} + s.doc_id) AS step
  FROM sig s JOIN sc ON s.doc_id = sc.doc_id),
greedy(step, kept_bks, doc_id, dropped) AS (
  SELECT 0::BIGINT, []::UBIGINT[], NULL::BIGINT, NULL::BOOLEAN
  UNION ALL
  SELECT o.step, CASE WHEN list_has_any(g.kept_bks, o.bks) THEN g.kept_bks ELSE list_concat(g.kept_bks, o.bks) END,
         o.doc_id, list_has_any(g.kept_bks, o.bks)
  FROM greedy g JOIN ordered o ON o.step = g.step + 1),
status AS (SELECT o.doc_id, o.step, g.dropped, unnest(o.bks) AS bk FROM greedy g JOIN ordered o ON o.step = g.step),
best AS (SELECT bk, min(step) AS step FROM status WHERE NOT dropped GROUP BY bk),
tag AS (SELECT s.doc_id, min(b.step) AS step FROM status s JOIN best b USING (bk) WHERE s.dropped GROUP BY s.doc_id)
SELECT g.doc_id, g.dropped AS near_duplicate, k.doc_id AS dup_of
FROM greedy g LEFT JOIN tag ON tag.doc_id = g.doc_id LEFT JOIN ordered k ON k.step = tag.step WHERE g.step > 0
UNION ALL
SELECT doc_id, false, NULL FROM documents WHERE coalesce(length(text), 0) < {P.min_content_length}""")


ORACLE_SQL["near_duplicates"] = _near_dup_sql()


# ------------------------------------------------------- varied tables ----

def _address_sql(template: str) -> str:
    out = q(template)
    for name, value in (("{lang}", f"(substr('{LETTERS}', page_id // 24 % 26 + 1, 1) || substr('{LETTERS}', page_id // {24 * 26} % 26 + 1, 1))"),
                        ("{page}", f"(page_id % {PAGES_PER_QUERY} + 1)::VARCHAR"),
                        ("{id10}", "lpad(page_id::VARCHAR, 10, '0')"), ("{id}", "page_id::VARCHAR")):
        out = f"replace({out}, {q(name)}, {value})"
    return out


def _varied_ctes() -> str:
    url = " ".join(f"WHEN {k} THEN {_address_sql(t)}" for k, t in ADDRESSES)
    html = " ".join(f"WHEN {k} THEN html || {q(t)}" for k, t in MARKUP)
    text = " ".join(f"WHEN {k} THEN text || {q(t)}" for k, t in PHRASES)
    return f"""varied_pages AS (SELECT page_id, CASE page_id % 24 {url} ELSE url END AS url,
  CASE page_id % 7 {html} WHEN {EMPTY} THEN '' ELSE html END AS html FROM pages),
varied_documents AS (SELECT * REPLACE (CASE doc_id % 5 {text} ELSE text END AS text) FROM documents),
"""


def _over_varied(sql: str) -> str:
    head, body = re.match(r"\s*(WITH (?:RECURSIVE )?)(.*)", sql, re.S).groups()
    return head + _varied_ctes() + re.sub(r"\b(FROM|JOIN) (pages|documents)\b", r"\1 varied_\2", body)


ORACLE_SQL.update({f"varied_{name}": _over_varied(ORACLE_SQL[name]) for name in VARIED})

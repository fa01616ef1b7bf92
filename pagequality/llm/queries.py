"""The corpus operators as registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fingerprints, hard_negatives, licenses, line_dedup, mixing, ngram_join, quality_bayes, quality_rules, secret_scan, spelling, suffix_dedup, warc
from .common import table

QUERIES = {
    "op1_line_dedup": lambda spark, sf: line_dedup.line_digest(table(spark, sf, "documents")),
    "op2_ngram_jaccard": lambda spark, sf: ngram_join.near_duplicates(table(spark, sf, "documents")),
    "op3_decontaminate": lambda spark, sf: decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op4_warc": lambda spark, sf: warc.round_trip(table(spark, sf, "pages")),
    "op5_licenses": lambda spark, sf: licenses.license_report(table(spark, sf, "documents")),
    "op6_mixing": lambda spark, sf: mixing.mixture(table(spark, sf, "documents")),
    "op7_secret_scan": lambda spark, sf: secret_scan.scan(table(spark, sf, "documents")),
    "op8_suffix_dedup": lambda spark, sf: suffix_dedup.suffix_digest(table(spark, sf, "documents")),
    "op9_quality_rules": lambda spark, sf: quality_rules.quality_verdicts(table(spark, sf, "documents")),
    "op10_quality_bayes": lambda spark, sf: quality_bayes.quality(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op11_spelling_variants": lambda spark, sf: spelling.spelling_variants(table(spark, sf, "documents")),
    "op12_fingerprints": lambda spark, sf: fingerprints.fingerprint_pairs(table(spark, sf, "documents")),
    "op13_hard_negatives": lambda spark, sf: hard_negatives.hard_negatives(table(spark, sf, "embeddings")),
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i+2]) WHEN len(w) > 0 THEN [w] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)""",
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, true AS complete
FROM f""",
    "op8_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
b AS MATERIALIZED (SELECT doc_id, n, pos, substr(h, 2 * pos + 1, 1122) AS h FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 512)) AS pos FROM d WHERE n >= 50)),
a AS MATERIALIZED (SELECT doc_id, pos + i AS i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, pos, h, unnest(range(0, least(512, n - 49 - pos))) AS i FROM b)),
m AS (SELECT hash(s) AS k FROM a GROUP BY k HAVING min(doc_id) < max(doc_id)),
w AS MATERIALIZED (SELECT a.* FROM a JOIN m ON hash(a.s) = m.k),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
x AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE w.doc_id > f.first),
g AS (SELECT doc_id, i, CASE WHEN i > coalesce(max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM x),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM k GROUP BY ALL),
p AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM r),
q AS (SELECT p.doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept
      FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL AND last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)""",
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS hex FROM r WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(hex) // 2), lambda i: ('0x' || substr(hex, (2 * i + 1)::BIGINT, 2))::BIGINT)),
                             lambda x, b: xor(x >> 8, t[((xor(x, b) & 255) + 1)::BIGINT])), 4294967295) AS h FROM c, t),
w AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
k AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM (SELECT *, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS x FROM k) a JOIN (SELECT *, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS x FROM k) b ON a.x = b.x AND a.word <> b.word),
d AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM k),
q AS (SELECT * FROM p UNION ALL SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.less UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.less),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n FROM q GROUP BY 1),
b AS (SELECT g.word, min(near) AS best FROM g JOIN q ON q.word = g.word AND q.near_n = g.best_n GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN g USING (word) LEFT JOIN b USING (word)), u AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT u.word, f.word, f.form FROM u JOIN f ON f.word = u.next)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM f JOIN u ON u.word = f.word AND u.next IS NULL""",
    "op13_hard_negatives": r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, other_id AS positive_id, s AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, s AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other_id) QUALIFY rank <= 3""",
}

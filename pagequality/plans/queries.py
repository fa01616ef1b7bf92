"""Registered query plans over the input tables.

Each plan takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
are aliased and typed (integers ``bigint``, ratios rounded) so the SQL
oracle can produce the same rows.  Documents act as session entries with
``source`` as the session and ``doc_id`` as the entry order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as fh
from ..functions import urls as fu
from ..functions.domain import registered_domain, split_domain
from ..operators import digest as dg
from ..operators.affinity import sample_affinity
from ..operators.dedup import dedup_status, exact_duplicates
from ..operators.filters import classify_results, filter_counts
from ..operators.first_seen import (cross_query_first_seen, first_seen, order_key, page_budget,
                                    results_view, search_results)
from ..operators.minhash import minhash_signature, shingle_count
from ..operators.outcome import scrape_log, with_outcome
from ..operators.relevance import cosine_relevance, label_query_vectors, lexical_relevance
from ..operators.score import tier, with_domain_signals, with_html_signals, with_quality, with_text_signals
from ..operators.transcripts import transcript_stats
from ..params import DEFAULT
from ..sources.blocklists import custom_blocked
from ..sources.tables import read_table
from .varied import varied

R = 6  # decimals for double outputs


def _long(c):
    return c.cast("long")


def _flags(c):
    return F.array_join(c, ",")


# ---------------------------------------------------------------- pages ----

def pages_with_content(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    return p.withColumn("content", fh.extract_text(F.col("html")))


def q_url_projections(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    canon = fu.canonical_url(F.col("url"))
    host = fu.url_host(canon)
    return p.select(
        "page_id",
        canon.alias("canon"),
        fu.url_extension(canon).alias("ext"),
        host.alias("host"),
        _long(F.size(fu.host_suffixes(host))).alias("n_suffixes"),
        F.array_join(fu.host_suffixes(host), "|").alias("suffixes"),
        fu.listing_host(F.col("url")).alias("listing_host"),
        fu.page_type(F.col("url")).alias("page_type"),
        fu.rewrite_url(F.col("url")).alias("fetch_url"),
        fu.is_video_url(F.col("url")).alias("is_video"),
        fu.video_id(F.col("url")).alias("video_id"),
    )


def _classified(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    res = results_view(p)
    return classify_results(res, custom_blocked(spark).select("domain"))


def q_result_filter_counts(spark, sf):
    c = filter_counts(_classified(spark, sf), ["query"])
    return c.select("query", *[_long(F.col(x)).alias(x) for x in ("total", "skipped_ext", "skipped_blocked", "kept")])


def q_page_budget(spark, sf):
    c = _classified(spark, sf).withColumn("_o", order_key("page", "pos"))
    firsts = c.where(F.col("drop_reason").isNull()).groupBy("query", "canon").agg(F.min("_o").alias("_f"))
    c = c.join(firsts, ["query", "canon"], "left").withColumn(
        "is_new", F.col("drop_reason").isNull() & (F.col("_o") == F.col("_f")))
    b = page_budget(c, DEFAULT, DEFAULT.cli_limit)
    return b.select("query", _long(F.col("page")).alias("page"), _long(F.col("filtered")).alias("filtered"),
                    _long(F.col("kept_new")).alias("kept_new"))


def q_search_results(spark, sf):
    r = search_results(_classified(spark, sf), DEFAULT, DEFAULT.cli_limit)
    return r.select("query", _long(F.col("page")).alias("page"), _long(F.col("pos")).alias("pos"),
                    "canon", _long(F.col("rank")).alias("rank"))


def q_cross_query_dedup(spark, sf):
    r = search_results(_classified(spark, sf), DEFAULT, DEFAULT.cli_limit)
    u = cross_query_first_seen(r, "query")
    return u.select("query", _long(F.col("pos")).alias("pos"), "canon")


def q_query_result_counts(spark, sf):
    r = search_results(_classified(spark, sf), DEFAULT, DEFAULT.cli_limit)
    u = cross_query_first_seen(r, "query").select("query", "canon").withColumn("_u", F.lit(1))
    j = r.join(u, ["query", "canon"], "left")
    return j.groupBy("query").agg(_long(F.count("*")).alias("results"),
                                  _long(F.count("_u")).alias("unique_after_cross"),
                                  _long(F.count("*") - F.count("_u")).alias("dupes"))


def q_first_seen_events(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    e = e.withColumn("_o", F.struct("ts", "event_id"))
    f = first_seen(e, "event_type", "_o", ["user_id"])
    return f.select("user_id", "event_type", "event_id")


def q_extract_text(spark, sf):
    p = read_table(spark, sf, "pages")
    c = fh.extract_text(F.col("html"))
    return p.select("page_id", c.alias("content"), _long(F.length(c)).alias("content_len"))


def q_page_title(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", fh.page_title(F.col("html")).alias("title"))


def q_html_markdown(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", fh.html_to_markdown(F.col("html")).alias("markdown"))


def q_html_signals(spark, sf):
    p = pages_with_content(spark, sf)
    h = with_html_signals(p, "html", "content", "h")
    return h.select("page_id", _long(F.col("h.points")).alias("points"), _flags(F.col("h.flags")).alias("flags"),
                    _long(F.col("h.code_blocks")).alias("code_blocks"), _long(F.col("h.links")).alias("links"),
                    F.round("h.density", R).alias("link_density"), _long(F.col("h.nav_len")).alias("nav_len"),
                    F.col("h.nav_ratio").alias("nav_ratio"), _long(F.col("h.ad_scripts")).alias("ad_scripts"))


def q_domain_signals(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    d = with_domain_signals(p, "url", None, "d")
    d = d.withColumn("_rd", split_domain(registered_domain(F.col("url"))))
    return d.select("page_id", F.col("d.domain").alias("domain"), F.col("_rd.name").alias("name"),
                    F.col("_rd.suffix").alias("suffix"), _long(F.col("d.points")).alias("points"),
                    _flags(F.col("d.flags")).alias("flags"))


def scored_pages(spark, sf):
    p = pages_with_content(spark, sf)
    return with_quality(p, "content", html_col="html", url_col="url")


def q_page_score(spark, sf):
    q = scored_pages(spark, sf)
    return q.select("page_id", _long(F.col("quality.score")).alias("score"),
                    _flags(F.col("quality.flags")).alias("flags"), F.col("quality.page_type").alias("page_type"),
                    F.col("quality.relevance").alias("relevance"), tier(F.col("quality.score")).alias("tier"))


def q_page_outcome(spark, sf):
    o = with_outcome(read_table(spark, sf, "pages"))
    return o.select("page_id", "outcome", "error", _long(F.length("content")).alias("content_len"))


def q_scrape_log(spark, sf):
    o = with_outcome(read_table(spark, sf, "pages"))
    return scrape_log(o)


def _page_entries(spark, sf):
    q = scored_pages(spark, sf)
    v = results_view(read_table(spark, sf, "pages", ["page_id", "url"])) \
        .where(F.col("query").startswith("lang:")).select("page_id", F.col("query").alias("session"))
    return q.join(v, "page_id").select(
        "session", F.col("page_id").alias("ord"), fh.page_title(F.col("html")).alias("title"), "url", "content",
        "html", F.col("quality.score").alias("score"), F.col("quality.relevance").alias("relevance"),
        F.col("quality.page_type").alias("page_type"), F.col("quality.flags").alias("flags"))


def q_page_listing(spark, sf):
    e = _page_entries(spark, sf)
    return dg.page_listing(e).select("session", _long(F.col("ord")).alias("ord"), "tier", "score_text", "rel",
                                     "host", "title60")


def q_page_view(spark, sf):
    e = _page_entries(spark, sf).withColumn("markdown", fh.html_to_markdown(F.col("html")))
    return dg.page_view(e, "markdown").select("session", _long(F.col("ord")).alias("ord"), "header", "body")


# ------------------------------------------------------------ documents ----

def docs(spark, sf, columns=None):
    return read_table(spark, sf, "documents", columns)


def q_text_signals(spark, sf):
    d = with_text_signals(docs(spark, sf, ["doc_id", "text"]), "text", out="t")
    t = lambda f: F.col("t." + f)
    return d.select(
        "doc_id", _long(t("points")).alias("points"), _flags(t("flags")).alias("flags"),
        _long(t("word_count")).alias("word_count"), t("top_word").alias("top_word"),
        F.round(t("top_ratio"), R).alias("top_ratio"), _long(t("repeated_bigrams")).alias("repeated_bigrams"),
        F.round(t("bigram_ratio"), R).alias("bigram_ratio"), _long(t("sentences")).alias("sentences"),
        F.round(t("cv"), R).alias("sentence_cv"), _long(t("slop_phrase_count")).alias("slop_phrases"),
        _long(t("discussion_count")).alias("discussion_markers"),
        _long(t("readability_words")).alias("readability_words"), _long(t("syllables")).alias("syllables"),
        F.round(t("flesch"), R).alias("flesch"), F.round(t("grade"), R).alias("grade"),
    )


def scored_docs(spark, sf):
    d = docs(spark, sf, ["doc_id", "text", "source"])
    return with_quality(d, "text", out="quality")


def q_document_score(spark, sf):
    q = scored_docs(spark, sf)
    return q.select("doc_id", _long(F.col("quality.score")).alias("score"),
                    _flags(F.col("quality.flags")).alias("flags"), tier(F.col("quality.score")).alias("tier"))


def q_query_score(spark, sf):
    """Documents scored with a query (their first line), a rank list and an AI score; hosts, ranks
    and AI scores come from the ids."""
    d = docs(spark, sf, ["doc_id", "text"])
    host = F.concat(F.lit("host"), (F.col("doc_id") % 40).cast("string"), F.lit(".com"))
    d = d.withColumns({"query": F.regexp_extract("text", r"^([^\n]*)", 1), "domain": host,
                       "url": F.concat(F.lit("https://"), host, F.lit("/"), F.col("doc_id").cast("string")),
                       "ai": F.when(F.col("doc_id") % 11 == 0, 0.9).otherwise(0.0)})
    ident = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("doc_id").alias("id"))
    texts = d.select(F.explode(F.array(F.struct(ident("q").alias("tid"), F.col("query").alias("text")),
                                       F.struct(ident("t").alias("tid"), "text"))).alias("x")).select("x.*")
    rel = lexical_relevance(d.select(ident("q").alias("query_key"), ident("t").alias("text_key")), texts, "tid", "text")
    ranks = d.groupBy("domain").agg(F.pow(F.lit(10), F.min("doc_id") % 7).cast("int").alias("rank"))
    d = d.drop("domain").join(rel.select(F.col("text_key.id").alias("doc_id"), "relevance"), "doc_id", "left")
    q = with_quality(d, "text", url_col="url", query_col="query", relevance_col="relevance", ai_col="ai",
                     ranks=ranks)
    return q.select("doc_id", _long(F.col("quality.score")).alias("score"), _flags(F.col("quality.flags")).alias("flags"),
                    F.col("quality.relevance").alias("relevance"), tier(F.col("quality.score")).alias("tier"))


def doc_entries(spark, sf):
    q = scored_docs(spark, sf)
    return q.select(F.col("source").alias("session"), F.col("doc_id").alias("ord"),
                    F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"),
                    F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/doc/"),
                             F.col("doc_id").cast("string")).alias("url"),
                    F.col("text").alias("content"), F.col("text").alias("snippet"),
                    F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("error"),
                    F.col("quality.score").alias("score"), F.col("quality.relevance").alias("relevance"),
                    F.col("quality.page_type").alias("page_type"), F.col("quality.flags").alias("flags"))


def doc_sessions(spark, sf):
    d = docs(spark, sf, ["doc_id", "source"])
    return d.groupBy(F.col("source").alias("session")).agg(_long(F.count("*")).alias("total")).select(
        "session", F.col("session").alias("query"), F.array(F.col("session")).alias("queries"), "total",
        F.lit(0).cast("long").alias("dedup_removed"))


def q_session_stats(spark, sf):
    return dg.session_stats(doc_entries(spark, sf))


def q_run_summary(spark, sf):
    return dg.run_summary(doc_entries(spark, sf))


def q_session_listing(spark, sf):
    return dg.session_listing(doc_entries(spark, sf), doc_sessions(spark, sf))


def q_digest_parts(spark, sf):
    p = dg.digest_parts(doc_entries(spark, sf), doc_sessions(spark, sf))
    return p.select("session", _long(F.col("block")).alias("block"), F.round("sort_key", R).alias("sort_key"),
                    "ord", _long(F.col("part_no")).alias("part_no"), "part")


def q_snippet_view(spark, sf):
    s = dg.snippet_view(doc_entries(spark, sf))
    return s.select("session", _long(F.col("ord")).alias("ord"), "heading", "url", "snippet")


def q_prompt_rows(spark, sf):
    return dg.prompt_rows(doc_entries(spark, sf), doc_sessions(spark, sf)).select(
        "session", _long(F.col("ord")).alias("ord"), "prompt")


def q_slug_names(spark, sf):
    s = doc_sessions(spark, sf)
    return s.select("session", fu.slugify(F.col("query")).alias("slug"),
                    fu.session_name(F.lit("search"), F.col("queries")).alias("file_name"),
                    fu.session_query(F.lit(None).cast("string"), F.col("queries")).alias("display_query"))


def q_exact_duplicates(spark, sf):
    d = docs(spark, sf, ["doc_id", "text"])
    idx = d.where(F.length("text") >= DEFAULT.min_content_length)
    e = exact_duplicates(idx, "doc_id", "text", None)
    return e.select("doc_id", "exact_keep", _long(F.col("copies")).alias("copies"))


def q_shingle_counts(spark, sf):
    d = docs(spark, sf, ["doc_id", "text"])
    return d.select("doc_id", shingle_count(F.col("text")).alias("shingles"))


def q_minhash_signature(spark, sf):
    d = docs(spark, sf, ["doc_id", "text"]).where(F.length("text") >= DEFAULT.min_content_length)
    sig = minhash_signature(F.col("text"))
    return d.select("doc_id", F.array_join(sig.cast("array<string>"), ",").alias("signature"))


def q_near_duplicates(spark, sf):
    q = scored_docs(spark, sf).select("doc_id", "text", F.col("quality.score").alias("score"))
    r = dedup_status(q, "doc_id", "text", "score")
    return r.select("doc_id", "near_duplicate", "dup_of")


def q_sample_affinity(spark, sf):
    d = docs(spark, sf, ["doc_id", "text"])
    b = read_table(spark, sf, "benchmark", ["item_id", "text"])
    a = sample_affinity(d, "doc_id", "text", b)
    return a.select("doc_id", "grams", "covered", F.round("affinity", R).alias("affinity"), "ai_score")


# ----------------------------------------------------- vectors, turns ------

def q_vector_relevance(spark, sf):
    e = read_table(spark, sf, "embeddings")
    qv = label_query_vectors(e)
    r = cosine_relevance(e, "embedding", qv.select("label", "query_vec"), "label")
    return r.select("vec_id", "label", F.round("relevance", R).alias("relevance"))


def q_transcripts(spark, sf):
    c = read_table(spark, sf, "conversations")
    return transcript_stats(c, "conv_id", "turn", "text").select(
        "conv_id", "segments", "chars", "words", _long(F.col("first_turn")).alias("first_turn"),
        _long(F.col("last_turn")).alias("last_turn"))


def q_lexical_relevance(spark, sf):
    c = read_table(spark, sf, "conversations")
    conv, turn = _long(F.col("conv_id")), _long(F.col("turn"))
    at = F.struct(conv.alias("c"), turn.alias("t"))
    texts = c.select(at.alias("tid"), "text")
    pairs = (c.where(F.col("role") == "assistant")
             .select(F.struct(conv.alias("c"), (turn - 1).alias("t")).alias("query_key"), at.alias("text_key")))
    r = lexical_relevance(pairs, texts, "tid", "text")
    return r.select(F.col("text_key.c").alias("conv_id"), F.col("query_key.t").alias("query_turn"), F.col("text_key.t").alias("text_turn"),
                    F.round("relevance", R).alias("relevance"))


QUERIES = {
    "url_projections": q_url_projections,
    "result_filter_counts": q_result_filter_counts,
    "page_budget": q_page_budget,
    "search_results": q_search_results,
    "cross_query_dedup": q_cross_query_dedup,
    "query_result_counts": q_query_result_counts,
    "first_seen_events": q_first_seen_events,
    "extract_text": q_extract_text,
    "page_title": q_page_title,
    "html_markdown": q_html_markdown,
    "html_signals": q_html_signals,
    "domain_signals": q_domain_signals,
    "page_score": q_page_score,
    "page_outcome": q_page_outcome,
    "scrape_log": q_scrape_log,
    "page_listing": q_page_listing,
    "page_view": q_page_view,
    "text_signals": q_text_signals,
    "document_score": q_document_score,
    "query_score": q_query_score,
    "session_stats": q_session_stats,
    "run_summary": q_run_summary,
    "session_listing": q_session_listing,
    "digest_parts": q_digest_parts,
    "snippet_view": q_snippet_view,
    "prompt_rows": q_prompt_rows,
    "slug_names": q_slug_names,
    "exact_duplicates": q_exact_duplicates,
    "shingle_counts": q_shingle_counts,
    "minhash_signature": q_minhash_signature,
    "near_duplicates": q_near_duplicates,
    "sample_affinity": q_sample_affinity,
    "vector_relevance": q_vector_relevance,
    "transcripts": q_transcripts,
    "lexical_relevance": q_lexical_relevance,
}

#: Run a second time over the varied tables, where every rule has rows that it concerns.
VARIED = ("url_projections", "result_filter_counts", "page_budget", "search_results", "cross_query_dedup",
          "query_result_counts", "html_signals", "domain_signals", "page_outcome", "scrape_log", "page_score",
          "text_signals", "document_score", "run_summary")
QUERIES.update({f"varied_{name}": lambda spark, sf, q=QUERIES[name]: q(spark, varied(sf)) for name in VARIED})

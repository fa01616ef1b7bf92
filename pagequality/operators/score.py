"""Feature composition and the 0-100 quality score (DataFrame -> DataFrame).

All row-local: no shuffle except the optional popularity-rank lookup, whose
side is broadcast only after its row count is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain as fd
from ..functions import html as fh
from ..functions import text as ft
from ..functions.urls import page_type as page_type_col
from ..params import DEFAULT, Params
from .joins import sized_broadcast
from .text_stats import text_stats


def with_text_signals(df: DataFrame, text_col: str = "text", ai_col: str | None = None,
                      out: str = "text_sig", params: Params = DEFAULT) -> DataFrame:
    """Adds ``out`` = struct(points, flags, details...) computed from ``text_col``; row-local."""
    joined = df.withColumn("_pq_st", text_stats(F.col(text_col), params))
    ai = F.coalesce(F.col(ai_col).cast("double"), F.lit(0.0)) if ai_col else F.lit(0.0)
    return joined.withColumn(out, _compose_text(F.col("_pq_st"), ai, params)).drop("_pq_st")


def _compose_text(st, ai, params: Params) -> Column:
    wc = st["word_count"]
    m = st["n_sent"]
    s1, s2 = st["s1"], st["s2"]
    cv = F.when(m > 5, F.sqrt((m * s2 - s1 * s1).cast("double") / (m * (m - 1)).cast("double"))
                / (s1.cast("double") / m.cast("double")))
    w = st["r_words"]
    sents = F.greatest(m, F.lit(1)).cast("double")
    wps = F.when(w > 0, w.cast("double") / sents).otherwise(F.lit(0.0))
    spw = F.when(w > 0, st["syllables"].cast("double") / w.cast("double")).otherwise(F.lit(0.0))
    flesch = F.lit(206.835) - F.lit(1.015) * wps - F.lit(84.6) * spw
    grade = F.lit(0.39) * wps + F.lit(11.8) * spw - F.lit(15.59)
    slop, disc = st["slop"], st["disc"]
    kw_ratio = F.when(st["n_long"] > 0, st["top_n"].cast("double") / st["n_long"].cast("double"))
    rep = st["rep_bigrams"]
    rep_ratio = F.when(wc > 20, rep.cast("double") / F.greatest(wc - 1, F.lit(1)).cast("double"))
    p_read = F.when(flesch < 10, -5).when((flesch >= 30) & (flesch <= 70), 5).otherwise(0)
    p_ai = F.when(ai > 0.5, params.ai_penalty).otherwise(0)
    p_len = F.when(wc < 100, -25).when(wc < 200, -10).when(wc > 500, 5).otherwise(0)
    p_kw = F.when(kw_ratio > 0.05, -10).otherwise(0)
    p_rep = F.when(rep_ratio > 0.05, -10).otherwise(0)
    p_cv = F.when(cv < 0.3, -5).otherwise(0)
    p_slop = F.when(slop >= 3, -15).when(slop >= 1, -3).otherwise(0)
    p_disc = F.when(disc >= 2, 10).otherwise(0)
    flags = F.array_compact(F.array(
        F.when(flesch < 10, F.lit("very_hard_to_read")),
        F.when(ai > 0.5, F.lit("likely_ai")),
        F.when(wc < 100, F.lit("thin")).when(wc < 200, F.lit("short")),
        F.when(kw_ratio > 0.05, F.concat(F.lit("keyword_stuffing:"), st["top_word"])),
        F.when(rep_ratio > 0.05, F.lit("repetitive")),
        F.when(cv < 0.3, F.lit("uniform_sentences")),
        F.when(slop >= 3, F.concat(F.lit("slop_phrases:"), slop.cast("string"))),
        F.when(disc >= 2, F.lit("discussion")),
    ))
    return F.struct(
        (p_read + p_ai + p_len + p_kw + p_rep + p_cv + p_slop + p_disc).alias("points"),
        flags.alias("flags"),
        flesch.alias("flesch"),
        grade.alias("grade"),
        F.round(flesch, 1).alias("flesch_reading_ease"),
        F.round(grade, 1).alias("grade_level"),
        F.round(ai, 2).alias("ai_score"),
        wc.alias("word_count"),
        st["top_word"].alias("top_word"),
        kw_ratio.alias("top_ratio"),
        F.when(kw_ratio > 0.05, F.round(kw_ratio, 3)).alias("keyword_stuffing_ratio"),
        rep.alias("repeated_bigrams"),
        rep_ratio.alias("bigram_ratio"),
        F.when(rep_ratio > 0.05, F.round(rep_ratio, 3)).alias("repetitive_bigram_ratio"),
        m.alias("sentences"),
        cv.alias("cv"),
        F.round(cv, 2).alias("sentence_variance"),
        slop.alias("slop_phrase_count"),
        disc.alias("discussion_count"),
        w.alias("readability_words"),
        st["syllables"].alias("syllables"),
        st["strip_len"].alias("strip_len"),
    )


def with_html_signals(df: DataFrame, html_col: str = "html", text_col: str = "content",
                      out: str = "html_sig", params: Params = DEFAULT) -> DataFrame:
    staged = df.withColumn("_pq_h", fh.html_signals_struct(F.col(html_col), F.col(text_col), params))
    h = F.col("_pq_h")
    pts = fh.html_points(h)
    present = F.coalesce(F.length(F.col(html_col)), F.lit(0)) > 0
    sig = F.when(present, F.struct(
        pts["points"].alias("points"), pts["flags"].alias("flags"),
        h["code_blocks"].alias("code_blocks"),
        F.when(h["comments"] >= 3, h["comments"]).alias("comment_sections"),
        h["links"].alias("links"),
        h["density"].alias("density"),
        F.round(h["density"], 2).alias("link_density"),
        h["nav_len"].alias("nav_len"),
        F.when(h["nav_len"] > 0, F.round(h["nav_ratio"], 3)).alias("nav_ratio"),
        h["ad_scripts"].alias("ad_scripts"),
    ))
    return staged.withColumn(out, sig).drop("_pq_h")


def with_domain_signals(df: DataFrame, url_col: str = "url", ranks: DataFrame | None = None,
                        out: str = "domain_sig", params: Params = DEFAULT) -> DataFrame:
    """Domain points; ``ranks(domain string, rank int)`` is an optional
    popularity list (unknown domains rank -1, as with no list at all)."""
    staged = df.withColumn("_pq_rd", fd.registered_domain(F.col(url_col), params))
    staged = staged.withColumn("_pq_dom", fd.split_domain(F.col("_pq_rd"))).drop("_pq_rd")
    if ranks is not None:
        r = ranks.select(F.col("domain").alias("_pq_rdom"), F.col("rank").cast("int").alias("_pq_rank"))
        r = r.groupBy("_pq_rdom").agg(F.min("_pq_rank").alias("_pq_rank"))
        staged = staged.join(sized_broadcast(r, 5_000_000), F.col("_pq_dom.domain") == F.col("_pq_rdom"), "left")
        rank = F.coalesce(F.col("_pq_rank"), F.lit(-1))
    else:
        rank = F.lit(-1)
    present = F.coalesce(F.length(F.col(url_col)), F.lit(0)) > 0
    sig = F.when(present, fd.domain_points(F.col("_pq_dom"), rank, params))
    out_df = staged.withColumn(out, sig).drop("_pq_dom")
    if ranks is not None:
        out_df = out_df.drop("_pq_rdom", "_pq_rank")
    return out_df


def tier(score: Column, params: Params = DEFAULT) -> Column:
    return (F.when(score >= params.tier_high, F.lit("HIGH"))
            .when(score >= params.tier_med, F.lit("MED")).otherwise(F.lit("LOW")))


def with_quality(df: DataFrame, text_col: str = "content", html_col: str | None = None,
                 url_col: str | None = None, query_col: str | None = None,
                 relevance_col: str | None = None, ai_col: str | None = None,
                 ranks: DataFrame | None = None, out: str = "quality",
                 params: Params = DEFAULT) -> DataFrame:
    """The composed score: baseline + domain + html + text + relevance,
    clamped to 0..100, with the empty-text and off-topic exits.

    ``relevance_col`` carries the relevance provider's output (cosine of
    query and text vectors, or the lexical provider); it is used only when
    the row has a query.  Row-local but for the rank lookup.
    """
    d = with_text_signals(df, text_col, ai_col, "_pq_ts", params)
    if html_col:
        d = with_html_signals(d, html_col, text_col, "_pq_hs", params)
    if url_col:
        d = with_domain_signals(d, url_col, ranks, "_pq_ds", params)
    text = F.col(text_col)
    ts = F.col("_pq_ts")
    empty = text.isNull() | (ts["strip_len"] < params.min_text)
    hs = F.col("_pq_hs") if html_col else F.lit(None)
    ds = F.col("_pq_ds") if url_col else F.lit(None)
    empty_arr = F.array().cast("array<string>")
    base = (F.lit(params.baseline) + F.coalesce(ds["points"] if url_col else F.lit(0), F.lit(0))
            + F.coalesce(hs["points"] if html_col else F.lit(0), F.lit(0)) + ts["points"])
    flags = F.concat(F.coalesce(ds["flags"], empty_arr) if url_col else empty_arr,
                     F.coalesce(hs["flags"], empty_arr) if html_col else empty_arr,
                     ts["flags"])
    has_query = (F.coalesce(F.length(F.col(query_col)), F.lit(0)) > 0) if query_col else F.lit(False)
    rel = (F.coalesce(F.col(relevance_col).cast("double"), F.lit(0.0)) if relevance_col else F.lit(0.0))
    rel = F.when(has_query, rel).otherwise(F.lit(0.0))
    wc = ts["word_count"]
    off_topic = has_query & (rel < params.off_topic) & (wc > 200)
    r_pts = (F.when(~has_query, 0).when(rel >= params.high_relevance, 15)
             .when(rel >= params.moderate_relevance, 8)
             .when((rel < params.low_relevance) & (wc > 200), -15).otherwise(0))
    r_flag = (F.when(~has_query, F.lit(None)).when(rel >= params.high_relevance, F.lit("highly_relevant"))
              .when(rel >= params.moderate_relevance, F.lit("relevant"))
              .when((rel < params.low_relevance) & (wc > 200), F.lit("low_relevance")))
    ptype = page_type_col(F.col(url_col), params) if url_col else F.lit("unknown")
    if url_col:
        ptype = F.when(F.coalesce(F.length(F.col(url_col)), F.lit(0)) > 0, ptype).otherwise(F.lit("unknown"))
    score = F.when(off_topic, F.lit(0)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), base + r_pts)))
    all_flags = F.when(off_topic, F.concat(flags, F.array(F.lit("off_topic")))).otherwise(
        F.concat(flags, F.array_compact(F.array(r_flag))))
    q = F.when(empty, F.struct(
        F.lit(0).alias("score"), F.array(F.lit("empty")).alias("flags"), F.lit("unknown").alias("page_type"),
        F.lit(0.0).alias("relevance"), F.lit(None).cast("int").alias("text_points"),
    )).otherwise(F.struct(
        score.cast("int").alias("score"), all_flags.alias("flags"), ptype.alias("page_type"),
        F.round(rel, 3).alias("relevance"), ts["points"].alias("text_points"),
    ))
    out_df = d.withColumn(out, q)
    details = {"text": ts}
    if html_col:
        details["html"] = hs
    if url_col:
        details["domain"] = ds
    out_df = out_df.withColumn(out + "_details", F.when(~empty, F.struct(*[v.alias(k) for k, v in details.items()])))
    drop = ["_pq_ts"] + (["_pq_hs"] if html_col else []) + (["_pq_ds"] if url_col else [])
    return out_df.drop(*drop)

"""Session statistics, digests and text views over scored entries.

Entries are rows ``(session, ord, title, url, content, score, relevance,
page_type, flags)``; ``score``/``relevance`` may be NULL (unscored entries
default to 50 and 0.5 in the ranking, 50 and 0.0 in the digest lines).

A digest is emitted as ordered parts ``(session, sort keys, part)`` rather
than one collected string: joining a session's parts is the sink's job, so
no session -- however large -- is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..sources.ordered_text import write_ordered
from .positions import with_position
from .ranking import with_rank
from .score import tier


def _py_float_str(x: Column) -> Column:
    """Python ``str(float)`` for values rounded to 3 decimals (``0.0``, ``0.25``)."""
    s = F.format_number(x, 3)
    s = F.regexp_replace(F.replace(s, F.lit(","), F.lit("")), r"0+\z", "")
    return F.when(x.isNull(), F.lit("0.0")).otherwise(F.regexp_replace(s, r"\.\z", ".0"))


def digest_sort_key(score: Column, relevance: Column) -> Column:
    return F.coalesce(score, F.lit(50)).cast("double") * F.greatest(F.coalesce(relevance, F.lit(0.5)), F.lit(0.1))


def usable_for_digest(content: Column, score: Column, params: Params = DEFAULT) -> Column:
    return ((F.coalesce(F.length(content), F.lit(0)) >= params.min_length)
            & (F.coalesce(score, F.lit(50)) >= params.min_score))


def digest_rank(entries: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``session, ord, sort_key, rank`` of the usable entries: best first, equal keys in list order.

    Only the narrow columns are sorted, over all tasks, so a session of any size is ranked without a window over it."""
    d = entries.where(usable_for_digest(F.col("content"), F.col("score"), params))
    d = d.select("session", "ord", digest_sort_key(F.col("score"), F.col("relevance")).alias("sort_key"))
    return with_rank(d, ["session"], [F.desc("sort_key"), F.asc_nulls_last("ord")])


def digest_entries(entries: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Usable entries with their sort key and rendered part texts (K1+K2)."""
    d = entries.where(usable_for_digest(F.col("content"), F.col("score"), params))
    d = d.withColumn("sort_key", digest_sort_key(F.col("score"), F.col("relevance")))
    content = F.when(F.length("content") > params.max_chars,
                     F.concat(F.substring("content", 1, params.max_chars), F.lit(params.truncation_marker))
                     ).otherwise(F.col("content"))
    q = F.coalesce(F.col("score"), F.lit(50))
    header = F.concat(F.lit("## ["), tier(q, params), F.lit("] "), F.coalesce(F.col("title"), F.lit("")))
    line = F.concat(F.lit("quality: "), q.cast("string"), F.lit("/100 | relevance: "),
                    _py_float_str(F.col("relevance")), F.lit(" | type: "),
                    F.coalesce(F.col("page_type"), F.lit("unknown")))
    return d.withColumn("header", header).withColumn("score_line", line).withColumn("body", content)


def digest_parts(entries: DataFrame, sessions: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """All parts of every session's digest, in output order
    ``(session, block, sort_key desc, ord, part_no)``.

    ``sessions`` has ``session, query, total, dedup_removed``.  Joining
    ``part`` with ``"\\n\\n"`` in that order gives the digest text.
    """
    de = digest_entries(entries, params)
    usable = de.groupBy("session").agg(F.count("*").alias("usable"))
    hdr = sessions.join(usable.withColumnRenamed("session", "_pq_s"), F.col("session").eqNullSafe(F.col("_pq_s")), "left").drop("_pq_s").withColumn("usable", F.coalesce("usable", F.lit(0)))
    filtered = F.col("total") - F.col("usable")
    meta = F.concat_ws(", ",
                       F.concat(F.col("usable").cast("string"), F.lit(" sources")),
                       F.when(filtered > 0, F.concat(filtered.cast("string"), F.lit(" low-quality filtered out"))),
                       F.when(F.col("dedup_removed") > 0,
                              F.concat(F.col("dedup_removed").cast("string"), F.lit(" near-duplicates removed"))))
    head = hdr.select("session", F.lit(0).alias("block"), F.lit(None).cast("double").alias("sort_key"),
                      F.lit(None).cast("long").alias("ord"),
                      F.explode(F.array(
                          F.struct(F.lit(0).alias("part_no"), F.concat(F.lit("# Research: "), F.col("query")).alias("part")),
                          F.struct(F.lit(1).alias("part_no"),
                                   F.concat(F.lit("_Scored and ranked by content quality. "), meta, F.lit("._\n")).alias("part")),
                      )).alias("p")).select("session", "block", "sort_key", "ord", "p.part_no", "p.part")
    body = de.select("session", F.lit(1).alias("block"), "sort_key", F.col("ord").cast("long").alias("ord"),
                     F.explode(F.array(
                         F.struct(F.lit(0).alias("part_no"), F.col("header").alias("part")),
                         F.struct(F.lit(1).alias("part_no"), F.col("score_line").alias("part")),
                         F.struct(F.lit(2).alias("part_no"), F.col("body").alias("part")),
                         F.struct(F.lit(3).alias("part_no"), F.lit("").alias("part")),
                     )).alias("p")).select("session", "block", "sort_key", "ord", "p.part_no", "p.part")
    return head.unionByName(body)


def write_digests(entries: DataFrame, sessions: DataFrame, path: str, params: Params = DEFAULT) -> None:
    """Every session's digest as numbered text files below ``path/name=<session>``; their texts in name order are the digest."""
    parts = digest_parts(entries, sessions, params)
    order = [F.asc("block"), F.desc("sort_key"), F.asc_nulls_last("ord"), F.asc("part_no")]
    write_ordered(parts, path, "session", order, "part", separator="\n\n")


def order_digest_parts(parts: DataFrame) -> DataFrame:
    """Global sort into output order (range-partitioned, so a large session
    is spread over many tasks)."""
    return parts.orderBy("session", "block", F.col("sort_key").desc(), "ord", "part_no")


def session_stats(entries: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """total / usable / filtered / chars / tokens per session."""
    n = F.coalesce(F.length("content"), F.lit(0))
    longer = n > params.min_length
    ok = F.coalesce(F.col("score"), F.lit(50)) >= params.min_score
    usable = longer & ok
    return entries.groupBy("session").agg(
        F.count("*").cast("long").alias("total"),
        F.count_if(usable).cast("long").alias("usable"),
        F.count_if(longer & ~ok).cast("long").alias("filtered"),
        F.sum(F.when(usable, F.least(n, F.lit(params.max_chars))).otherwise(0)).cast("long").alias("chars"),
    ).withColumn("tokens", F.floor(F.col("chars") / params.tokens_per_char).cast("long"))


def run_summary(entries: DataFrame, logs: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """Per session: Σ length of contents longer than 50 (uncapped) // 4 and
    the counters; ``level`` is ``warn`` when anything was blocked or failed.
    ``logs`` has ``session, scraped, blocked, errors``; without it the counts
    come from the entries (content > 50 scraped, error set = error)."""
    n = F.coalesce(F.length("content"), F.lit(0))
    agg = entries.groupBy("session").agg(
        F.sum(F.when(n > params.min_text, n).otherwise(0)).cast("long").alias("chars"),
        F.count_if(n > params.min_text).cast("long").alias("scraped_rows"),
        F.count_if(F.col("error").isNotNull()).cast("long").alias("error_rows"),
    )
    if logs is not None:
        agg = agg.join(logs, "session", "left")
    else:
        agg = (agg.withColumn("scraped", F.col("scraped_rows")).withColumn("blocked", F.lit(0).cast("long"))
               .withColumn("errors", F.col("error_rows")))
    tokens = F.floor(F.col("chars") / params.tokens_per_char).cast("long")
    level = F.when((F.col("blocked") > 0) | (F.col("errors") > 0), F.lit("warn")).otherwise(F.lit("done"))
    msg = F.concat_ws(", ",
                      F.concat(F.col("scraped").cast("string"), F.lit(" scraped")),
                      F.when(F.col("blocked") > 0, F.concat(F.col("blocked").cast("string"), F.lit(" blocked"))),
                      F.when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" errors"))),
                      F.concat(F.lit("~"), F.format_number(tokens, 0), F.lit(" tokens")))
    return agg.select("session", F.col("chars"), tokens.alias("tokens"), F.col("scraped").cast("long").alias("scraped"),
                      F.col("blocked").cast("long").alias("blocked"), F.col("errors").cast("long").alias("errors"),
                      level.alias("level"), msg.alias("message"))


def session_listing(entries: DataFrame, sessions: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per session: pages with content longer than 50, query cut to 80,
    chars and tokens of those pages.  Where ``sessions`` has ``mtime``, ``place`` numbers them newest first (ties by name)."""
    n = F.coalesce(F.length("content"), F.lit(0))
    agg = entries.groupBy("session").agg(
        F.count_if(n > params.min_text).cast("long").alias("pages"),
        F.count("*").cast("long").alias("total"),
        F.sum(F.when(n > params.min_text, n).otherwise(0)).cast("long").alias("chars"),
    )
    out = sessions.drop("total").join(agg, "session", "left")
    place = []
    if "mtime" in sessions.columns:
        out = with_rank(out, [], [F.desc_nulls_last("mtime"), F.asc("session")], "place")
        place = ["place"]
    return out.select(*place, "session", F.substring("query", 1, 80).alias("query_80"), "pages", "total",
                      F.floor(F.col("chars") / params.tokens_per_char).cast("long").alias("tokens"),
                      F.concat(F.col("session"), F.lit("  |  "), F.col("pages").cast("string"),
                               F.lit(" pages  |  "), F.substring("query", 1, 80)).alias("line"))


def snippet_view(entries: DataFrame) -> DataFrame:
    """Numbered quick view: ``### i. title``, url, snippet (default '')."""
    d = with_position(entries, ["session"], "ord", "i")
    return d.select("session", "ord", "i",
                    F.concat(F.lit("### "), F.col("i").cast("string"), F.lit(". "),
                             F.coalesce("title", F.lit(""))).alias("heading"),
                    F.coalesce("url", F.lit("")).alias("url"),
                    F.coalesce("snippet", F.lit("")).alias("snippet"))


def page_listing(entries: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Listing lines for entries with content of at least 50 characters."""
    from ..functions.urls import listing_host
    d = entries.where(F.coalesce(F.length("content"), F.lit(0)) >= params.min_text)
    sc = F.col("score")
    t = F.when(sc.isNull(), F.lit("LOW")).otherwise(tier(sc, params))
    rel = F.coalesce(F.col("relevance"), F.lit(0.0))
    return d.select("session", "ord", t.alias("tier"),
                    F.coalesce(sc.cast("string"), F.lit("?")).alias("score_text"),
                    F.format_number(rel, 2).alias("rel"),
                    listing_host(F.coalesce(F.col("url"), F.lit(""))).alias("host"),
                    F.substring(F.coalesce(F.col("title"), F.lit("Untitled")), 1, 60).alias("title60"))


def page_view(entries: DataFrame, markdown_col: str | None = None) -> DataFrame:
    """Preview header and body of every entry (select one with ``ord``)."""
    flags = F.when(F.size(F.coalesce("flags", F.array())) > 0,
                   F.concat(F.lit("flags: "), F.array_join("flags", ", ")))
    body = F.coalesce(F.col(markdown_col) if markdown_col else F.lit(None), F.nullif(F.col("content"), F.lit("")),
                      F.lit("No content extracted."))
    header = F.concat_ws("\n\n",
                         F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled"))),
                         F.coalesce("url", F.lit("")),
                         F.concat(F.lit("quality: "), F.coalesce(F.col("score").cast("string"), F.lit("?")),
                                  F.lit("/100 | relevance: "), _py_float_str(F.col("relevance")),
                                  F.lit(" | type: "), F.coalesce("page_type", F.lit("unknown"))),
                         flags, F.lit("---"))
    return entries.select("session", "ord", header.alias("header"), body.alias("body"))


def prompt_rows(entries: DataFrame, sessions: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """Inference prompts for analysable entries (content longer than 50):
    content cut to the model input size; the entry's own query (an empty one stays), else all
    session queries joined by a space."""
    d = entries.where(F.coalesce(F.length("content"), F.lit(0)) > params.min_text)
    if sessions is not None:
        d = d.join(sessions.select("session", F.array_join("queries", " ").alias("_all_q")), "session", "left")
        q = F.coalesce(F.col("query"), F.col("_all_q"), F.lit(""))
    else:
        q = F.coalesce(F.col("query"), F.lit(""))
    pre, rest = params.prompt_template.split("{query}")
    mid, post = rest.split("{content}")
    prompt = F.concat(F.lit(pre), q, F.lit(mid), F.substring("content", 1, params.llm_max_input_chars), F.lit(post))
    return d.select("session", "ord", prompt.alias("prompt"))


def page_view_at(entries: DataFrame, session: str, index: int, markdown_col: str | None = None) -> DataFrame:
    """The preview of entry ``index`` (0-based list position) of one session.

    Raises ``IndexError`` when the session has no entry at that position
    (a single count of the session's entries is the only driver round trip).
    """
    d = entries.where(F.col("session") == session)
    n = d.count()
    if index < 0 or index >= n:
        raise IndexError(f"Index {index} out of range (0-{n - 1})")
    picked = with_position(d, ["session"], "ord", "_pq_pos").where(F.col("_pq_pos") == index + 1).drop("_pq_pos")
    return page_view(picked, markdown_col)

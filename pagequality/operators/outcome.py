"""Per-page fetch outcome and the scrape counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import extract_text
from ..functions.urls import is_video_url
from ..params import DEFAULT, Params
from .alignment import refused


def with_outcome(pages: DataFrame, transcripts: DataFrame | None = None, params: Params = DEFAULT,
                 url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds ``content``, ``outcome`` (scraped / error / none) and ``error``.

    Optional page columns: ``success`` (default: html present),
    ``error_message``, ``is_exception`` (the fetch raised: an error, never a refusal).
    ``transcripts(url, transcript)`` supplies video text.
    """
    cols = pages.columns
    success = F.col("success") if "success" in cols else F.coalesce(F.length(html_col), F.lit(0)) > 0
    message = F.col("error_message") if "error_message" in cols else F.lit(None).cast("string")
    raised = F.coalesce(F.col("is_exception"), F.lit(False)) if "is_exception" in cols else F.lit(False)
    d = pages
    if transcripts is not None:
        d = d.join(transcripts.select(F.col("url").alias("_pq_u"), F.col("transcript").alias("_pq_tr")),
                   F.col(url_col) == F.col("_pq_u"), "left").drop("_pq_u")
        tr = F.nullif(F.col("_pq_tr"), F.lit(""))
    else:
        tr = F.lit(None).cast("string")
    video = is_video_url(F.col(url_col))
    has_html = F.coalesce(F.length(html_col), F.lit(0)) > 0
    content = F.when(video, tr).when(has_html & ~raised, extract_text(F.col(html_col)))
    d = d.withColumn("content", content)
    long_ = F.coalesce(F.length("content"), F.lit(0)) > params.min_text
    outcome = (F.when(video, F.when(F.col("content").isNotNull(), F.lit("scraped")).otherwise(F.lit("error")))
               .when(raised, F.lit("error"))
               .when(long_, F.lit("scraped")).when(~F.coalesce(success, F.lit(False)), F.lit("error")).otherwise(F.lit("none")))
    error = (F.when(video & F.col("content").isNull(), F.lit("No transcript available"))
             .when(~video & (raised | (~long_ & ~F.coalesce(success, F.lit(False)))), message))
    d = d.withColumn("outcome", outcome).withColumn("error", error)
    d = d.withColumn("is_blocked_fetch", refused(success, message, raised))
    return d.drop("_pq_tr") if transcripts is not None else d


def scrape_log(outcomes: DataFrame, group_cols=()) -> DataFrame:
    """blocked / scraped / errors / total counters."""
    return outcomes.groupBy(*group_cols).agg(
        F.count_if(F.col("is_blocked_fetch")).cast("long").alias("blocked"),
        F.count_if(F.col("outcome") == "scraped").cast("long").alias("scraped"),
        F.count_if(F.col("outcome") == "error").cast("long").alias("errors"),
        F.count("*").cast("long").alias("total"),
    )


def run_log(rows: DataFrame, session_col: str = "session") -> DataFrame:
    """The log of every session and of all together (``session`` null, ``level`` 1), in one pass over its result rows.

    ``rows`` has one row a result: ``fetched`` (it has a page), ``is_blocked_fetch`` and ``outcome`` of the page, ``near_duplicate`` of the
    entry.  A result without a page counts in ``total`` and ``dropped_tail`` only."""
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    return rows.groupingSets([[F.col(session_col)], []], F.col(session_col)).agg(
        F.grouping(session_col).cast("int").alias("level"),
        F.count("*").cast("long").alias("total"), count(~F.col("fetched")).alias("dropped_tail"),
        count(F.col("is_blocked_fetch")).alias("blocked"), count(F.col("outcome") == "scraped").alias("scraped"),
        count(F.col("outcome") == "error").alias("errors"), count(F.col("near_duplicate")).alias("dedup_removed"))

"""Result filters: skip-extension and blocklist.

The blocklist test depends only on the host, so it runs over the distinct
hosts (a map-side-combined aggregate far smaller than the rows), explodes the
host's parent suffixes, and semi-joins them to the blocked domains.  The rows
are then anti-joined with the blocked hosts; AQE broadcasts that side when it
is small and splits a hot host's partition when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, host_suffixes, url_extension, url_host
from ..params import DEFAULT, Params


def with_url_columns(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``canon``, ``ext`` and ``host`` (the canonical URL's projections)."""
    d = df.withColumn("canon", canonical_url(F.col(url_col)))
    return d.withColumn("ext", url_extension(F.col("canon"))).withColumn("host", url_host(F.col("canon")))


def skip_ext_mask(ext_col: str = "ext", params: Params = DEFAULT):
    return F.col(ext_col).isin(list(params.skip_extensions))


def blocked_hosts(df: DataFrame, blocked: DataFrame, host_col: str = "host") -> DataFrame:
    """Distinct hosts of ``df`` that are blocked themselves or by a parent."""
    hosts = df.select(F.col(host_col).alias("host")).where(F.col("host") != "").distinct()
    sfx = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    return sfx.join(blocked.select("domain").distinct(), "domain", "left_semi").select("host").distinct()


def with_blocked_flag(df: DataFrame, blocked: DataFrame, host_col: str = "host",
                      out: str = "is_blocked") -> DataFrame:
    bh = blocked_hosts(df, blocked, host_col).select(F.col("host").alias("_pq_bh"), F.lit(True).alias("_pq_b"))
    d = df.join(bh, F.col(host_col) == F.col("_pq_bh"), "left")
    return d.withColumn(out, F.coalesce(F.col("_pq_b"), F.lit(False))).drop("_pq_bh", "_pq_b")


def classify_results(df: DataFrame, blocked: DataFrame, url_col: str = "url",
                     params: Params = DEFAULT) -> DataFrame:
    """Adds canon/ext/host and ``drop_reason``: ``ext`` (skip list, tested
    first), ``blocked`` (host or parent blocked) or NULL (kept)."""
    d = with_url_columns(df, url_col)
    d = with_blocked_flag(d, blocked, "host")
    reason = F.when(skip_ext_mask("ext", params), F.lit("ext")).when(F.col("is_blocked"), F.lit("blocked"))
    return d.withColumn("drop_reason", reason).drop("is_blocked")


def filter_results(df: DataFrame, blocked: DataFrame, url_col: str = "url",
                   params: Params = DEFAULT) -> DataFrame:
    """Rows that survive both filters."""
    return classify_results(df, blocked, url_col, params).where(F.col("drop_reason").isNull())


def filter_counts(classified: DataFrame, group_cols=("query",)) -> DataFrame:
    """skipped_ext / skipped_blocked / kept per group (one aggregate)."""
    return classified.groupBy(*group_cols).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("drop_reason") == "ext").alias("skipped_ext"),
        F.count_if(F.col("drop_reason") == "blocked").alias("skipped_blocked"),
        F.count_if(F.col("drop_reason").isNull()).alias("kept"),
    )

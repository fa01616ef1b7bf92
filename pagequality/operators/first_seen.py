"""First-seen dedup, paging budget and per-query limit over result tables.

Result rows carry ``(query, page, pos)``; order inside a query is
``(page, pos)``.  No operator here needs a window over a whole query or a
whole URL group:

* first-seen keeps the minimum order key per (scope, key) with a map-side
  combined aggregate and joins it back, so one URL holding a third of all
  rows is pre-aggregated before the shuffle (AQE splits the skewed join
  partition);
* the paging rule works on the per-(query, page) aggregate, a few rows per
  query;
* the per-query limit is ``row_number() <= limit``, which Spark turns into a
  partial group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def order_key(*cols) -> F.Column:
    """The columns as one ordered key (first is major); values of any size keep apart."""
    return F.struct(*[F.col(c).cast("long").alias(f"k{i}") for i, c in enumerate(cols)])


def first_seen(df: DataFrame, key_col: str, order_col: str, scope_cols=()) -> DataFrame:
    """Rows that are the first (lowest ``order_col``) of their ``key_col``
    inside ``scope_cols``; later copies are dropped."""
    scope = list(scope_cols)
    firsts = df.groupBy(*scope, key_col).agg(F.min(order_col).alias("_pq_first"))
    joined = df.join(firsts, scope + [key_col], "inner")
    return joined.where(F.col(order_col) == F.col("_pq_first")).drop("_pq_first")


def page_budget(classified: DataFrame, params: Params = DEFAULT, limit: int | None = None,
                query_col: str = "query") -> DataFrame:
    """Pages a paging search would have read, per query.

    Page ``p`` is read iff pages ``1..p`` all exist and every earlier page
    lost at least one row to the filters while the first-seen rows kept so far
    stayed under ``limit``; at most ``max_pages`` pages.  Duplicates alone
    never open another page.  ``classified`` has ``drop_reason`` and ``is_new``
    (first sighting inside the query).
    """
    limit = params.search_limit if limit is None else limit
    per_page = classified.groupBy(query_col, "page").agg(
        F.count_if(F.col("drop_reason").isNotNull()).alias("filtered"),
        F.count_if(F.col("drop_reason").isNull() & F.col("is_new")).alias("kept_new"),
    )
    w = Window.partitionBy(query_col).orderBy("page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cont = (per_page
            .withColumn("_rn", F.row_number().over(w))
            .withColumn("_cum", F.sum("kept_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_go", (F.col("filtered") > 0) & (F.col("_cum") < limit))
            .withColumn("_all_go_before", F.coalesce(F.min(F.col("_go").cast("int")).over(before), F.lit(1)) == 1))
    return (cont.where((F.col("_rn") == F.col("page")) & F.col("_all_go_before") & (F.col("page") <= params.max_pages))
            .select(query_col, "page", "filtered", "kept_new"))


def search_results(classified: DataFrame, params: Params = DEFAULT, limit: int | None = None,
                   query_col: str = "query") -> DataFrame:
    """The per-query search output: filters, first-seen, paging, limit.

    ``classified`` has ``query, page, pos, canon, drop_reason``.
    """
    limit = params.search_limit if limit is None else limit
    c = classified.withColumn("_ord", order_key("page", "pos"))
    kept = c.where(F.col("drop_reason").isNull())
    firsts = kept.groupBy(query_col, "canon").agg(F.min("_ord").alias("_first"))
    c = (c.join(firsts, [query_col, "canon"], "left")
         .withColumn("is_new", F.col("drop_reason").isNull() & (F.col("_ord") == F.col("_first")))
         .drop("_first"))
    pages = page_budget(c, params, limit, query_col).select(query_col, "page")
    used = c.join(pages, [query_col, "page"], "left_semi").where(F.col("is_new"))
    w = Window.partitionBy(query_col).orderBy("page", "pos")
    return (used.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .drop("_ord", "is_new"))


def cross_query_first_seen(results: DataFrame, query_order_col: str = "query") -> DataFrame:
    """First sighting of each canonical URL over all queries, in
    (query order, page, pos) order."""
    r = results.withColumn("_g", F.struct(F.col(query_order_col), F.col("page"), F.col("pos")))
    firsts = r.groupBy("canon").agg(F.min("_g").alias("_gf"))
    return r.join(firsts, "canon").where(F.col("_g") == F.col("_gf")).drop("_g", "_gf")


def results_view(pages: DataFrame) -> DataFrame:
    """Search-result rows derived from a pages table.

    Each page answers two queries: its language path segment (``/en/...``)
    on the page given by its ``page=`` parameter, and a ``site:`` query named
    after the host's first label on page 1.  ``pos`` is the page id, so the
    order is stable and every URL shows up in two queries.
    """
    lang = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z]+://[^/]+/([a-z]{2})/", 1), F.lit("")),
                      F.lit("none"))
    page_no = F.coalesce(F.regexp_extract("url", r"[?&]page=([0-9]+)", 1).try_cast("int"), F.lit(1))
    first_label = F.regexp_extract("url", r"^[A-Za-z]+://([^./]+)\.", 1)
    a = pages.select(F.concat(F.lit("lang:"), lang).alias("query"), page_no.alias("page"),
                     F.col("page_id").alias("pos"), "url", "page_id")
    b = pages.select(F.concat(F.lit("site:"), first_label).alias("query"), F.lit(1).alias("page"),
                     F.col("page_id").alias("pos"), "url", "page_id")
    return a.unionByName(b)

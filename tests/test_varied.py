"""Over the varied tables every rule has rows that it concerns."""

import pytest
from pyspark.sql import functions as F

from pagequality.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def flags(df, col="flags"):
    return {r[0] for r in df.select(F.explode(F.split(col, ","))).distinct().collect()}


@pytest.mark.parametrize("col", ["skipped_ext", "skipped_blocked", "kept"])
def test_filters_drop(spark, col):
    assert QUERIES["varied_result_filter_counts"](spark, SF).agg(F.sum(col)).first()[0] > 0


def test_paging_goes_on(spark):
    assert QUERIES["varied_page_budget"](spark, SF).agg(F.max("page")).first()[0] > 1


def test_addresses(spark):
    u = QUERIES["varied_url_projections"](spark, SF).cache()
    assert {r[0] for r in u.select("page_type").distinct().collect()} >= {
        "qa", "wiki", "docs", "code", "discussion", "article", "product", "unknown"}
    assert u.where("is_video").count() == u.where("video_id is not null").count() > 0
    assert u.where("fetch_url like '%old.reddit.com%'").count() > 0


def test_domain_flags(spark):
    found = flags(QUERIES["varied_domain_signals"](spark, SF))
    assert found >= {"institutional_tld", "junk_tld", "hyphen_stuffed", "long_domain", "year_in_domain", "bad_url"}
    assert any(f.startswith("seo_domain") for f in found)


def test_html_flags(spark):
    assert flags(QUERIES["varied_html_signals"](spark, SF)) >= {"has_code", "has_comments", "ad_heavy"}


def test_phrases(spark):
    t = QUERIES["varied_text_signals"](spark, SF).agg(F.max("slop_phrases"), F.max("discussion_markers")).first()
    assert t[0] >= 3 and t[1] >= 3


def test_outcomes(spark):
    assert {r[0] for r in QUERIES["varied_page_outcome"](spark, SF).select("outcome").distinct().collect()} >= {"scraped", "error"}


def test_query_rank_and_ai_flags(spark):
    found = flags(QUERIES["query_score"](spark, "/root/testdata/sf0.01"))
    assert found >= {"off_topic", "highly_relevant", "relevant", "low_relevance", "top_1k", "top_10k", "top_100k", "likely_ai"}

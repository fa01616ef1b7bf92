from pyspark.sql import functions as F

from pagequality.operators import digest as dg
from pagequality.operators.filters import classify_results
from pagequality.operators.first_seen import search_results


def _results(spark, rows):
    """rows: (page, pos, url)"""
    df = spark.createDataFrame([("q", p, s, u) for p, s, u in rows], "query string, page int, pos int, url string")
    blocked = spark.createDataFrame([("blocked.com",)], "domain string")
    return classify_results(df, blocked)


def test_paging_filtered_page_opens_next(spark):
    # limit 3; page 1: 2 kept, 1 blocked; page 2: 2 kept, 0 filtered -> first 3, page 3 unread
    rows = [(1, 1, "https://a.com/1"), (1, 2, "https://blocked.com/x"), (1, 3, "https://a.com/2"),
            (2, 1, "https://a.com/3"), (2, 2, "https://a.com/4"), (3, 1, "https://a.com/5")]
    got = [r.canon for r in search_results(_results(spark, rows), limit=3).orderBy("rank").collect()]
    assert got == ["https://a.com/1", "https://a.com/2", "https://a.com/3"]


def test_paging_duplicates_do_not_open_next(spark):
    rows = [(1, 1, "https://a.com/1"), (1, 2, "https://a.com/1?x"), (1, 3, "https://a.com/1#y"),
            (2, 1, "https://a.com/2")]
    got = [r.canon for r in search_results(_results(spark, rows), limit=3).collect()]
    assert got == ["https://a.com/1"]


def _entries(spark, rows):
    return spark.createDataFrame(rows, "session string, ord long, title string, url string, content string, "
                                       "score int, relevance double, page_type string, snippet string")


def test_digest_order_and_header(spark):
    body = "x" * 250
    e = _entries(spark, [("s", 1, "A", "u1", body, 60, 0.5, "docs", ""), ("s", 2, "B", "u2", body, 90, 0.0, None, ""),
                         ("s", 3, "C", "u3", body, None, None, None, ""), ("s", 4, "D", "u4", "short", 80, 0.9, None, ""),
                         ("s", 5, "E", "u5", body, 10, 0.9, None, "")])
    sessions = spark.createDataFrame([("s", "my query", 5, 2)], "session string, query string, total long, dedup_removed long")
    parts = dg.order_digest_parts(dg.digest_parts(e, sessions)).collect()
    text = "\n\n".join(p.part for p in parts)
    assert text.startswith("# Research: my query\n\n_Scored and ranked by content quality. 3 sources, "
                           "2 low-quality filtered out, 2 near-duplicates removed._\n")
    # keys 30, 9, 25 -> A, C, B
    heads = [p.part for p in parts if p.part.startswith("## ")]
    assert heads == ["## [MED] A", "## [MED] C", "## [HIGH] B"]
    assert "quality: 50/100 | relevance: 0.0 | type: unknown" in text


def test_stats_vs_digest_boundary(spark):
    e = _entries(spark, [("s", 1, "A", "u", "y" * 200, 50, 0.5, None, "")])
    st = dg.session_stats(e).first()
    assert st.usable == 0 and st.total == 1
    assert dg.digest_entries(e).count() == 1


def test_snippet_positions(spark):
    e = _entries(spark, [("s", o, f"T{o}", "u", "c", 50, 0.5, None, "sn") for o in (5, 9000, 3, 70000)])
    got = [r.heading for r in dg.snippet_view(e).orderBy("ord").collect()]
    assert got == ["### 1. T3", "### 2. T5", "### 3. T9000", "### 4. T70000"]


def test_page_view_at(spark):
    import pytest
    e = _entries(spark, [("s", o, f"T{o}", "u", "body", 50, 0.25, "docs", "") for o in (7, 3, 11)])
    e = e.withColumn("flags", F.array(F.lit("has_code")))
    v = dg.page_view_at(e, "s", 1).first()
    assert v.ord == 7 and v.header.startswith("# T7\n\nu\n\nquality: 50/100 | relevance: 0.25 | type: docs")
    assert "flags: has_code" in v.header and v.body == "body"
    with pytest.raises(IndexError):
        dg.page_view_at(e, "s", 3)

from pyspark.sql import functions as F

from pagequality.operators.filters import classify_results, with_blocked_flag, with_url_columns
from pagequality.sources.blocklists import (blocklist_counts, parse_blocklist_line, read_blocklists,
                                            read_word_list)

LINES = [
    ("*://*.hoarder.info/*", "hoarder.info"), ("*://pixel-farm.biz/*", "pixel-farm.biz"), ("copycat.example.org", "copycat.example.org"),
    ("#*://*.off.net/*", None), ("!heading", None), ("   ", None), ("*://*.t.co/*", None), ("t.co", None),
    ("*://news.host.org/sports/*", None), ("*://*.MixedCase.Dev/*", "mixedcase.dev"), ("@*://*.allowed.net/*", None), ("/ads[0-9]+/", None),
    ("  *://feeds.host.org/*  ", "feeds.host.org"),
]


def test_line_grammar(spark):
    df = spark.createDataFrame([(line,) for line, _ in LINES], "line string")
    got = [r[0] for r in df.select(parse_blocklist_line(F.col("line"))).collect()]
    assert got == [d for _, d in LINES]


def test_blocked_hosts(spark):
    blocked = spark.createDataFrame([("spamfarm.org",)], "domain string")
    want = {"http://spamfarm.org": True, "https://deep.er.spamfarm.org/a?b": True, "https://WWW.SpamFarm.org/": True,
            "https://notspamfarm.org/": False, "spamfarm.org/no-scheme": False, "http://spamfarm.org:8443/": False, "https://spamfarm.org.net/": False}
    df = with_url_columns(spark.createDataFrame([(u,) for u in want], "url string"))
    assert {r.url: r.is_blocked for r in with_blocked_flag(df, blocked).collect()} == want


def test_read_blocklists_and_counts(spark, tmp_path):
    f = tmp_path / "mine.txt"
    f.write_text("! mine\ncopycat.example.org\n*://*.hoarder.info/*\n\n*://pixel-farm.biz/*\ncopycat.example.org\n*://a.example.com/x/*\n")
    lists = read_blocklists(spark, [str(f), str(tmp_path / "none.txt")])
    from_file = {r.domain for r in lists.where(F.col("list") == "mine").collect()}
    assert from_file == {"copycat.example.org", "hoarder.info", "pixel-farm.biz"}
    assert lists.where(F.col("domain") == "x.com").count() == 1  # custom list bypasses the parser
    counts = {r.list: r.domains for r in blocklist_counts(lists).collect()}
    assert counts["mine"] == 3 and counts["custom"] == 20 and counts[None] == 23


def test_word_list(spark, tmp_path):
    f = tmp_path / "greek.txt"
    f.write_text("alpha\n#beta\n gamma\n\n\t\ndelta epsilon \n  # zeta\n")
    got = [r.value for r in read_word_list(spark, str(f)).orderBy("ord").collect()]
    assert got == ["alpha", "gamma", "delta epsilon", "# zeta"]


def test_filter_order_ext_before_blocked(spark):
    blocked = spark.createDataFrame([("refused.net",)], "domain string")
    df = spark.createDataFrame([("https://refused.net/a.pdf",), ("https://refused.net/a",), ("https://ok.com/a.zip?x",),
                                ("https://ok.com/a",)], "url string")
    got = [r.drop_reason for r in classify_results(df, blocked).orderBy("url").collect()]
    assert got == [None, "ext", "blocked", "ext"]


def test_unicode_hosts_and_tabs(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from pagequality.sources.blocklists import parse_blocklist_line, read_word_list

    lines = ["*://*.b\u00fccher-laden.net/*", "stra\u00dfe.example.com", "nope"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r[0] for r in df.select(parse_blocklist_line(F.col("value"))).collect()] == ["b\u00fccher-laden.net", "stra\u00dfe.example.com", None]
    (tmp_path / "w.txt").write_text("\tone\t\n\t\n two \n#no\n", encoding="utf-8")
    assert [r.value for r in read_word_list(spark, str(tmp_path / "w.txt")).orderBy("ord").collect()] == ["one", "two"]
    assert read_word_list(spark, str(tmp_path / "missing.txt")).count() == 0
    with pytest.raises(Exception):
        read_word_list(spark, "nosuchscheme://x/y")

from pyspark.sql import functions as F

from pagequality.functions import urls as fu
from pagequality.functions.domain import registered_domain, split_domain

URLS = [  # url, canonical, ext, host
    ("https://a.com/x.PDF?q=1", "https://a.com/x.PDF", ".pdf", "a.com"),
    ("https://a.com", "https://a.com", ".com", "a.com"),
    ("https://a.com/.pdf", "https://a.com/.pdf", "", "a.com"),
    ("https://a.com/.a.b", "https://a.com/.a.b", ".b", "a.com"),
    ("https://a.com/a.tar.gz#z", "https://a.com/a.tar.gz", ".gz", "a.com"),
    ("https://a.com/p.pdf/", "https://a.com/p.pdf/", "", "a.com"),
    ("http://www.B.com:80/x", "http://www.B.com:80/x", "", "b.com:80"),
    ("https://www.www.c.com", "https://www.www.c.com", ".com", "www.c.com"),
    ("not-a-url", "not-a-url", "", ""),
]


def test_url_goldens(spark):
    df = spark.createDataFrame([(u,) for u, *_ in URLS], "url string")
    c = fu.canonical_url(F.col("url"))
    got = df.select("url", c.alias("c"), fu.url_extension(c).alias("e"), fu.url_host(c).alias("h")).collect()
    assert [(r.url, r.c, r.e, r.h) for r in got] == URLS


def test_rewrite(spark):
    want = {"http://m.reddit.com/user/x?u=reddit.com": "http://m.old.reddit.com/user/x?u=old.reddit.com", "https://myreddit.com": "https://myold.reddit.com",
            "https://reddit.org/": "https://reddit.org/", "": ""}
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert [r[0] for r in df.select(fu.rewrite_url(F.col("url"))).collect()] == list(want.values())


def test_page_type_order(spark):
    df = spark.createDataFrame([("https://forum.x.org/a",), ("https://x.org/blog/docs/a",),
                                ("https://threads.net/t",), ("https://x.org/a?/wiki/",)], "url string")
    got = [r[0] for r in df.select(fu.page_type(F.col("url"))).collect()]
    assert got == ["discussion", "docs", "discussion", "unknown"]


def test_video(spark):
    df = spark.createDataFrame([("https://www.youtube.com/watch?v=abcdefghijk",), ("https://youtu.be/abcdefghijk",),
                                ("https://m.youtube.com/watch?v=abcdefghijk",)], "url string")
    got = [(r[0], r[1]) for r in df.select(fu.is_video_url(F.col("url")), fu.video_id(F.col("url"))).collect()]
    assert got == [(True, "abcdefghijk"), (True, "abcdefghijk"), (False, "abcdefghijk")]


def test_slug_and_session_query(spark):
    df = spark.createDataFrame([("Hello, World! -- Spark", ["a b", "c"])], "t string, qs array<string>")
    r = df.select(fu.slugify(F.col("t")), fu.session_name(F.lit("search"), F.col("qs")),
                  fu.session_query(F.lit(""), F.col("qs"))).first()
    assert r[0] == "hello-world-spark"
    assert r[1] == "search-a-b-c.json"
    assert r[2] == "a b, c"


def test_registered_domain(spark):
    rows = [("https://news.bbc.co.uk/x", "bbc.co.uk", "co.uk"), ("https://a.b.example.com", "example.com", "com"),
            ("http://127.0.0.1/x", "", ""), ("https://localhost/", "", ""), ("not-a-url", "", ""),
            ("https://user@shop.best-deals-2024.xyz:8080/p", "best-deals-2024.xyz", "xyz")]
    df = spark.createDataFrame([(u,) for u, *_ in rows], "url string")
    got = df.select(split_domain(registered_domain(F.col("url"))).alias("d")).select("d.domain", "d.suffix").collect()
    assert [(r.domain, r.suffix) for r in got] == [(d, s) for _, d, s in rows]

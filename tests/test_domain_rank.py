from pyspark.sql import functions as F

from pagequality.operators.score import with_domain_signals


def test_rank_flags(spark):
    pages = spark.createDataFrame([(1, "https://www.top.example.com/a"), (2, "https://mid.org/x"),
                                   (3, "https://tail.net/"), (4, "https://nobody.io/"),
                                   (5, "https://best-cheap-deals-2024.xyz/p"), (6, "https://cs.uni.edu/")],
                                  "id long, url string")
    ranks = spark.createDataFrame([("example.com", 10), ("mid.org", 5000), ("tail.net", 500000)],
                                  "domain string, rank int")
    out = {r.id: r.d for r in with_domain_signals(pages, "url", ranks, "d").collect()}
    assert out[1].points == 15 and out[1].flags == ["top_1k"] and out[1].tranco_rank == 10
    assert out[2].points == 10 and out[2].flags == ["top_10k"]
    assert out[3].points == 2 and out[3].flags == []
    assert out[4].tranco_rank == -1 and out[4].points == 0
    assert out[5].flags == ["junk_tld", "hyphen_stuffed", "year_in_domain", "seo_domain:best,cheap,deals"]
    assert out[5].points == -10 - 10 - 8 - 8
    assert out[6].flags == ["institutional_tld"] and out[6].points == 5

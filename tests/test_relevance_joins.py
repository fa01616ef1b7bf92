from pagequality.operators.joins import sized_broadcast
from pagequality.operators.relevance import cosine_relevance, lexical_relevance


def test_lexical_relevance_bounds(spark):
    texts = spark.createDataFrame([(1, "spark joins and shuffles"), (2, "spark joins and shuffles"),
                                   (3, "completely different words here"), (4, "")], "tid long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "query_key long, text_key long")
    got = {r.text_key: r.relevance for r in lexical_relevance(pairs, texts, "tid", "text").collect()}
    assert abs(got[2] - 1.0) < 1e-12 and got[3] == 0.0 and got[4] == 0.0


def test_cosine_relevance(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [-1.0, 0.0]), (3, "b", [0.0, 0.0]), (4, "c", None)],
                                 "id long, q string, v array<double>")
    qs = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [1.0, 1.0])], "q string, query_vec array<double>")
    got = {r.id: r.relevance for r in cosine_relevance(rows, "v", qs, "q").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_sized_broadcast_checks_size(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    assert "broadcast" in str(sized_broadcast(small, 100)._jdf.queryExecution().analyzed()).lower()
    assert "broadcast" not in str(sized_broadcast(small, 5)._jdf.queryExecution().analyzed()).lower()

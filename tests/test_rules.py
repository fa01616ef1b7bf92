from pyspark.sql import functions as F

from pagequality.functions.urls import canonical_url
from pagequality.operators.digest import page_view, prompt_rows
from pagequality.operators.outcome import scrape_log, with_outcome
from pagequality.operators.transcripts import stripped_segments
from pagequality.plans.queries import q_lexical_relevance


def test_canonical_url_ends_at_the_line(spark):
    df = spark.createDataFrame([("http://a.example/x?q=1#f",), ("http://a.example/x?q\nrest",)], "u string")
    assert [r[0] for r in df.select(canonical_url(F.col("u"))).collect()] == ["http://a.example/x", "http://a.example/x\nrest"]


def test_refused_video_counts_as_blocked(spark):
    rows = [("https://www.youtube.com/watch?v=abcdefghijk", None, False, "HTTP 403"), ("https://b.example/p", None, False, "HTTP 403"),
            ("https://b.example/q", None, False, "timeout")]
    df = spark.createDataFrame(rows, "url string, html string, success boolean, error_message string")
    r = scrape_log(with_outcome(df)).first()
    assert (r.blocked, r.errors, r.total) == (2, 3, 3)


def test_segments_are_stripped_and_stay(spark):
    df = spark.createDataFrame([(1, " a\n"), (2, "\t"), (3, None)], "turn int, text string")
    assert [r.text for r in stripped_segments(df).orderBy("turn").collect()] == ["a", "", ""]


def test_empty_content_gets_the_message_and_empty_queries_stay(spark):
    long_ = "w" * 60
    df = spark.createDataFrame([("s", 0, "", ""), ("s", 1, long_, ""), ("s", 2, long_, None)], "session string, ord int, content string, query string")
    df = df.withColumns({"flags": F.array().cast("array<string>"), "title": F.lit("t"), "url": F.lit("u"), "score": F.lit(1),
                         "relevance": F.lit(0.0), "page_type": F.lit("unknown")})
    assert [r.body for r in page_view(df).orderBy("ord").collect()] == ["No content extracted.", long_, long_]
    sessions = spark.createDataFrame([("s", ["needle one", "two"])], "session string, queries array<string>")
    got = {r.ord: r.prompt for r in prompt_rows(df, sessions).collect()}
    assert "needle one two" not in got[1] and "needle one two" in got[2]


def test_turns_beyond_100000_stay_in_their_conversation(spark, tmp_path):
    rows = [(1, 100000, "user", "apples pears"), (1, 100001, "assistant", "apples pears"), (2, 0, "user", "stone"), (2, 1, "assistant", "sand")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.query_turn, r.text_turn): r.relevance for r in q_lexical_relevance(spark, str(tmp_path)).collect()}
    assert got == {(1, 100000, 100001): 1.0, (2, 0, 1): 0.0}

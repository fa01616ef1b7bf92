from pyspark.sql import functions as F

from pagequality.operators.score import with_quality, with_text_signals
from pagequality.params import Params

RIVERS = "Rivers carry silt toward quiet harbours. " * 90
NOTE = "Tiny note."
BULLETS = "A silver bullet needs a deep dive. Another silver bullet follows. " * 6
MOTION = "Maria seconded the motion and Piotr objected. " * 3
P = Params(ai_phrases=("silver bullet", "deep dive"), discussion_markers=("seconded", "objected"))


def _signals(spark, texts, params=P, ai=None):
    rows = [(i, t, (ai[i] if ai else None)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, ai double")
    out = with_text_signals(df, "text", ai_col="ai", params=params).orderBy("id")
    return [r.text_sig for r in out.collect()]


def _read_points(s):
    f = s.flesch
    return -5 if f < 10 else (5 if 30 <= f <= 70 else 0)


def test_text_goldens(spark):
    # goldens exclude readability: compare points minus the readability share
    rivers, note, bullets, motion = _signals(spark, [RIVERS, NOTE, BULLETS, MOTION])
    assert (rivers.word_count, rivers.top_word, rivers.top_ratio) == (540, "rivers", 0.2) and rivers.bigram_ratio == 6 / 539
    assert rivers.points - _read_points(rivers) == 5 - 10 - 5
    assert [f for f in rivers.flags if f != "very_hard_to_read"] == ["keyword_stuffing:rivers", "uniform_sentences"]
    assert note.points - _read_points(note) == -25 - 10 and note.flags == ["thin", "keyword_stuffing:note."]
    assert (bullets.word_count, bullets.slop_phrase_count, bullets.top_ratio) == (66, 2, 0.25) and bullets.bigram_ratio == 10 / 65
    assert bullets.points - _read_points(bullets) == -25 - 10 - 10 - 5 - 3
    assert bullets.flags == ["thin", "keyword_stuffing:silver", "repetitive", "uniform_sentences"]
    assert motion.points - _read_points(motion) == -25 - 10 + 10
    assert motion.flags == ["thin", "keyword_stuffing:maria", "discussion"]


def test_ai_penalty(spark):
    s = _signals(spark, [RIVERS], ai=[0.9])[0]
    assert "likely_ai" in s.flags


def test_rows_that_share_an_id_or_have_none(spark):
    df = spark.createDataFrame([(1, RIVERS), (1, RIVERS), (1, NOTE), (None, RIVERS), (None, None)], "id long, text string").repartition(3)
    rows = with_quality(df, "text", params=P).collect()
    alone = {r.text: r.quality for r in with_quality(spark.createDataFrame([(RIVERS,), (NOTE,), (None,)], "text string"), "text", params=P).collect()}
    assert len(rows) == 5 and all(r.quality == alone[r.text] for r in rows)
    assert sum(r.quality_details.text.word_count for r in rows if r.text == RIVERS) == 3 * 540


def test_tie_goes_to_first_occurrence(spark):
    s = _signals(spark, ["zebra apple zebra apple mango"])[0]
    assert s.top_word == "zebra" and s.flags[1] == "keyword_stuffing:zebra"


def test_unicode_whitespace_tokens(spark):
    s = _signals(spark, ["a b c\x1cd  e\n"])[0]
    assert s.word_count == 5


def test_relevance_rules(spark):
    words201 = " ".join(["word"] * 201)
    words200 = " ".join(["word"] * 200)
    df = spark.createDataFrame([(1, words201, "q", 0.14), (2, words200, "q", 0.14), (3, words200, "q", 0.55),
                                (4, words200, None, 0.9), (5, "   tiny  ", "q", 0.9)],
                               "id long, text string, query string, rel double")
    out = {r.id: r.quality for r in with_quality(df, "text", query_col="query", relevance_col="rel").collect()}
    assert out[1].score == 0 and out[1].flags[-1] == "off_topic" and out[1].relevance == 0.14
    assert "off_topic" not in out[2].flags and "low_relevance" not in out[2].flags
    assert "highly_relevant" in out[3].flags
    assert out[4].relevance == 0.0 and "highly_relevant" not in out[4].flags
    assert out[5].score == 0 and out[5].flags == ["empty"] and out[5].page_type == "unknown"


def test_score_bounds_on_pages(spark):
    from pagequality.plans.queries import q_page_score
    from sf_paths import SF001
    rows = q_page_score(spark, SF001).collect()
    assert rows and all(0 <= r.score <= 100 for r in rows)
    assert all(r.tier in ("HIGH", "MED", "LOW") for r in rows)

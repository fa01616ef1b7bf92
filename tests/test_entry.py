import importlib.util
import os

from sf_paths import SF001


def _entry_module():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    m = _entry_module()
    df = m.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"page_id", "score", "flags", "page_type", "relevance", "tier"}


def test_oracle_keys_are_registered():
    m = _entry_module()
    assert set(m.oracle_sql()) <= set(m.queries())


def test_cheap_queries_run(spark):
    m = _entry_module()
    for name in ("url_projections", "search_results", "vector_relevance", "transcripts", "first_seen_events"):
        assert m.queries()[name](spark, SF001).count() >= 0

import json
import os
import time

from pyspark.sql import functions as F

from pagequality.sources.sessions import (latest_session, read_results, read_sessions, session_entries,
                                          write_digest, write_session_json)


def test_read_results(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"query": "q1", "number_of_results": 2, "results": [
        {"url": "https://a.com/1", "title": "A", "content": "x"}, {"url": "https://b.com/2", "title": "B"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"query": "q2", "number_of_results": 0}))
    rows = read_results(spark, str(tmp_path), page=1).orderBy("query", "pos").collect()
    assert [(r.query, r.pos, r.url, r.page) for r in rows] == [("q1", 1, "https://a.com/1", 1), ("q1", 2, "https://b.com/2", 1)]


def test_session_roundtrip_and_latest(spark, tmp_path):
    entries = spark.createDataFrame(
        [("s1", 1, "T1", "https://a.com", "c1"), ("s1", 0, "T0", "https://b.com", "c0"), ("s2", 0, "U", "https://c.com", None)],
        "session_id string, ord long, title string, url string, content string")
    headers = spark.createDataFrame([("s1", ["q a"], "search"), ("s2", ["q b", "q c"], "search")],
                                    "session_id string, queries array<string>, mode string")
    out = str(tmp_path / "sessions")
    write_session_json(entries, headers, out)
    s = read_sessions(spark, out, multi_line=False)
    assert s.count() == 2
    e = session_entries(s).where(F.col("queries")[0] == "q a").orderBy("ord").collect()
    assert [r.title for r in e] == ["T0", "T1"]
    # newest file by modification time
    d = tmp_path / "many"
    d.mkdir()
    for i, name in enumerate(["old.json", "new.json"]):
        (d / name).write_text(json.dumps({"queries": [name], "mode": "search", "results": []}))
        os.utime(d / name, (time.time() + i * 10, time.time() + i * 10))
    assert [r.file for r in latest_session(read_sessions(spark, str(d))).collect()] == ["new.json"]


def test_write_digest(spark, tmp_path):
    df = spark.createDataFrame([("# Research: q\n\nbody",)], "digest string")
    out = str(tmp_path / "digest")
    write_digest(df, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert text.startswith("# Research: q")

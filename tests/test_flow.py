"""The flow's operators against plain Python: ranks, offsets, batch stop, positions, files, tags, suffix rules, filter."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pagequality.operators import bloom, digest, outcome
from pagequality.operators.alignment import batch_of, until_refused, zip_counts, zip_rows
from pagequality.operators.dedup import dedup_status
from pagequality.operators.ranking import with_offset, with_rank
from pagequality.operators.suffixes import with_domains
from pagequality.operators.transcripts import transcript_pieces
from pagequality.sources.blocklists import rank_table
from pagequality.sources.ordered_text import read_files, read_lines, write_ordered
from pagequality.sources.sessions import read_session_entries, read_sessions, write_session_documents


def hot_rows(n=3000, seed=1):
    """A group with two thirds of the rows, a null group, ties and null keys."""
    r = random.Random(seed)
    return [(r.choice(["hot"] * 8 + ["a", "b", None, None]), r.choice([None, *range(50)]), i) for i in range(n)]


def test_rank_and_offset_of_groups(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, k int, i long").repartition(7)
    order = [F.desc_nulls_last("k"), F.asc("i")]
    got = {r.i: (r["rank"], r.at) for r in with_offset(with_rank(df, ["g"], order), ["g"], order, F.col("i") % 5, "at").collect()}
    groups = {}
    for g, k, i in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2])):
        place, at = groups.get(g, (0, 0))
        assert got.pop(i) == (place + 1, at)
        groups[g] = (place + 1, at + i % 5)
    assert not got
    alone = {r.i: r["rank"] for r in with_rank(df, [], [F.asc("i")]).collect()}
    assert alone == {i: i + 1 for i in range(len(rows))}
    assert with_rank(df.limit(0), ["g"], order).count() == 0


def test_hot_group_is_ranked_by_many_tasks(spark):
    df = with_rank(spark.range(20_000).select(F.lit("one").alias("g"), F.xxhash64("id").alias("k")), ["g"], [F.asc("k")])
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 20_000


def plain_fetches(flags, sizes=(2, 3, 4)):
    out, i, k = [], 0, 0
    while i < len(flags):
        batch = flags[i: i + sizes[k % 3]]
        out += batch
        i += len(batch)
        k += 1
        if all(batch):
            break
    return len(out)


def test_batch_stop_and_positional_join(spark):
    r = random.Random(3)
    runs = {f"q{k}": [r.random() < 0.6 for _ in range(r.randint(1, 25))] for k in range(30)} | {"none": [False] * 20, "all": [True] * 9, None: [False, True, False, True, True, False]}
    rows = [(q, p, f) for q, flags in runs.items() for p, f in enumerate(flags, 1)]
    df = spark.createDataFrame(rows, "q string, position long, refused boolean").repartition(5)
    made = until_refused(df, ["q"])
    kept = {q: plain_fetches(flags) for q, flags in runs.items()}
    assert {x.q: x["count"] for x in made.groupBy("q").count().collect()} == kept
    left = df.select("q", (F.col("position") * 10).alias("p"))
    right = made.select("q", (F.col("position") * 7).alias("f"), "refused")
    z = [tuple(x) for x in zip_rows(left, right, ["q"], [F.asc("p")], [F.asc("f")]).select("q", "position", "p", "f", "refused").collect()]
    assert sorted(z, key=str) == sorted(((q, p, 10 * p, 7 * p, runs[q][p - 1]) for q, n in kept.items() for p in range(1, n + 1)), key=str)
    counts = {x.q: (x.results, x.matched, x.dropped_tail) for x in zip_counts(left, right, ["q"]).collect()}
    assert counts == {q: (len(runs[q]), n, len(runs[q]) - n) for q, n in kept.items()} and any(x[2] for x in counts.values())
    batches = [x[0] for x in spark.range(1, 12).select(batch_of(F.col("id"))).collect()]
    assert batches == [0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 3]


def test_flow_plans_reach_their_rules(spark):
    from sf_paths import SF01

    from pagequality.plans.flow import q_fetch_counts
    rows = q_fetch_counts(spark, SF01).collect()
    assert sum(r.dropped_tail for r in rows) > 0 and sum(r.matched for r in rows) > 0


def test_exceptions_are_no_refusals(spark):
    page = "<p>" + "word " * 40 + "</p>"
    df = spark.createDataFrame([(1, "https://a.org/1", None, False, "HTTP 403", False), (2, "https://a.org/2", None, None, "got 403 then died", True),
                                (3, "https://a.org/3", page, True, None, False), (4, "https://a.org/4", None, False, "HTTP 500", None),
                                (5, "https://youtu.be/abcdefghijk", page, True, None, False)],
                               "id int, url string, html string, success boolean, error_message string, is_exception boolean")
    o = outcome.with_outcome(df)
    assert [(r.outcome, r.error, r.is_blocked_fetch) for r in o.orderBy("id").collect()] == [
        ("error", "HTTP 403", True), ("error", "got 403 then died", False), ("scraped", None, False), ("error", "HTTP 500", False), ("error", "No transcript available", False)]
    rows = o.select(F.when(F.col("id") < 3, "s").otherwise("t").alias("session"), "outcome", "is_blocked_fetch", F.lit(True).alias("fetched"), (F.col("id") == 3).alias("near_duplicate"))
    rows = rows.unionByName(spark.createDataFrame([("t", None, None, False, None)], "session string, outcome string, is_blocked_fetch boolean, fetched boolean, near_duplicate boolean"))
    log = {(r.level, r.session): (r.total, r.dropped_tail, r.blocked, r.scraped, r.errors, r.dedup_removed) for r in outcome.run_log(rows).collect()}
    assert log == {(0, "s"): (2, 0, 1, 0, 2, 0), (0, "t"): (4, 1, 0, 1, 2, 1), (1, None): (6, 1, 1, 1, 4, 1)}


def test_ordered_files(spark, tmp_path):
    r = random.Random(5)
    docs = {name: ["".join(r.choice("ab\n é") for _ in range(r.randint(0, 9))) for _ in range(n)] for name, n in (("long/er=1", 900), ("b", 1), ("c", 3))}
    rows = [(name, k, x) for name, pieces in docs.items() for k, x in enumerate(pieces)] + [(None, 0, None), (None, 1, "x")]
    df = spark.createDataFrame(rows, "name string, k int, x string").repartition(6)
    path = str(tmp_path / "out")
    write_ordered(df, path, "name", [F.asc("k")], "x", separator="\n\n", max_pieces=50)
    docs["(none)"] = ["", "x"]
    lines = {name: [] for name in docs}
    for x in read_lines(spark, path, "\n\n").orderBy("line_no").collect():
        lines[x.name].append((x.line_no, x.line))
    for name, pieces in docs.items():
        assert lines[name] == list(enumerate("\n\n".join(pieces).split("\n"), 1))
    files = read_files(spark, path)
    assert files.where("name = 'long/er=1'").count() >= 18 and os.path.exists(os.path.join(path, "_SUCCESS"))
    with pytest.raises(Exception):
        write_ordered(df, path, "name", [F.asc("k")], "x")


def test_session_documents(spark, tmp_path):
    details = {"text": {"word_count": 3}}
    rows = [(s, k, f'Title "{k}"\n', "line\nline" if k else None, (k, ["a"], details, "docs", 0.5)) for s in ("s1", "s2") for k in range(40)]
    q = "struct<score:int,flags:array<string>,details:struct<text:struct<word_count:int>>,page_type:string,relevance:double>"
    e = spark.createDataFrame([(*x[:4], x[4]) for x in rows] + [("alone", 0, "T", None, None)], f"session string, ord int, title string, content string, quality {q}").repartition(5)
    h = spark.createDataFrame([("s1", ["q a"], "search"), ("s2", ["q b"], "search"), ("empty", ["q"], "search")], "session string, queries array<string>, mode string")
    path = str(tmp_path / "sessions")
    write_session_documents(e, h, path)
    for name, n in (("s1", 40), ("alone", 1), ("empty", 0)):  # files in name order are the document, valid JSON
        folder = tmp_path / "sessions" / f"name={name}"
        text = "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
        doc = json.loads(text)
        assert len(doc["results"]) == n and doc.get("mode") == (None if name == "alone" else "search")
        if name == "s1":
            (tmp_path / "whole").mkdir()
            (tmp_path / "whole" / "s1.json").write_text(text)
    back = read_session_entries(spark, path)
    got = back.where("name = 's2'").orderBy("ord").select("ord", "header.queries", "entry.*").collect()
    assert [(r.ord, r.title, r.content, r.quality.score, r.quality.details.text.word_count) for r in got] == [(k, f'Title "{k}"\n', "line\nline" if k else None, k, 3) for k in range(40)]
    assert got[0].queries == ["q b"] and back.where("name = 'alone'").count() == 1 and back.where("name = 'empty'").count() == 0
    one = read_sessions(spark, str(tmp_path / "whole")).first()
    assert len(one.results) == 40 and one.results[5].quality.details.text.word_count == 3


def test_digest_rank_and_listing(spark):
    rows = [("s", 1, "x" * 250, 60, 0.5), ("s", 2, "x" * 250, 90, 0.0), ("s", 3, "x" * 250, None, None), ("s", 4, "short", 99, 1.0), ("s", 5, "x" * 250, 60, 0.5), ("t", 1, "x" * 250, 10, 1.0)]
    e = spark.createDataFrame(rows, "session string, ord long, content string, score int, relevance double")
    assert sorted((r["rank"], r.ord) for r in digest.digest_rank(e).collect()) == [(1, 1), (2, 5), (3, 3), (4, 2)]
    s = spark.createDataFrame([("s", "q", 1, 5), ("t", "r", 1, 9), ("u", "v", 0, None)], "session string, query string, total long, mtime long")
    assert {r.session: r.place for r in digest.session_listing(e, s).collect()} == {"t": 1, "s": 2, "u": 3}


def test_positions_of_null_sessions_and_orders(spark):
    e = spark.createDataFrame([(None, 3, "A"), (None, 1, "B"), ("s", None, "C"), ("s", 9000, "D")], "session string, ord long, title string")
    e = e.withColumns({"url": F.lit(None).cast("string"), "snippet": F.lit(None).cast("string")})
    assert {r.heading for r in digest.snippet_view(e).collect()} == {"### 1. B", "### 2. A", "### 1. D", "### 2. C"}


def test_tags_name_the_best_kept_row(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in a cold and quiet cellar at night "
    rows = [(1, base * 2, 40, "a"), (2, base * 2, 80, "a"), (3, base * 2 + "x", 60, "a"), (4, "entirely other words " * 12, 50, "a"), (5, base * 2, 10, "b"), (6, "short", 50, "a"), (7, base * 2 + "xy", 60, "a")]
    df = spark.createDataFrame(rows, "ord long, text string, score int, scope string")
    got = {r.ord: (r.near_duplicate, r.dup_of) for r in dedup_status(df, "ord", "text", "score", scope_col="scope").collect()}
    assert got == {1: (True, 2), 2: (False, None), 3: (True, 2), 4: (False, None), 5: (False, None), 6: (False, None), 7: (True, 2)}
    with pytest.raises(Exception, match="must lie in"):
        dedup_status(df.withColumn("ord", -F.col("ord")), "ord", "text", "score").collect()


def test_suffix_rules(spark):
    rules = spark.createDataFrame([(x,) for x in ("com", "co.uk", "uk", "*.ck", "!www.ck", "// note", "", "*.kawasaki.jp", "!city.kawasaki.jp", "jp")], "rule string")
    want = {"a.b.example.com": ("example.com", "com"), "news.bbc.co.uk": ("bbc.co.uk", "co.uk"), "co.uk": ("", "co.uk"), "x.y.ck": ("x.y.ck", "y.ck"), "y.ck": ("", "y.ck"),
            "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "ck": ("", ""), "p.q.kawasaki.jp": ("p.q.kawasaki.jp", "q.kawasaki.jp"), "s.city.kawasaki.jp": ("city.kawasaki.jp", "kawasaki.jp"),
            "host.unknown": ("", ""), "10.0.0.1": ("", ""), "": ("", ""), None: ("", ""), "EXAMPLE.COM": ("example.com", "com")}
    df = spark.createDataFrame([(h,) for h in want] * 2, "host string")
    got = [(r.host, (r.domain, r.suffix)) for r in with_domains(df, rules).collect()]
    assert len(got) == 2 * len(want) and all(want[h] == x for h, x in got)


def test_filter_before_the_exact_join(spark):
    blocked = spark.range(20_000).select(F.concat(F.lit("bad"), F.col("id").cast("string"), F.lit(".net")).alias("domain"))
    hosts = spark.range(6000).select(F.concat(F.lit("w."), F.when(F.col("id") % 3 == 0, "bad").otherwise("good"), F.col("id").cast("string"), F.lit(".net")).alias("host"))
    parents = bloom.candidate_parents(hosts, blocked, bits=1 << 18)
    assert 2000 <= parents.count() < 2400  # of 18,000
    got = {r.host for r in bloom.blocked_hosts_by_filter(hosts, blocked, bits=1 << 18).collect()}
    assert got == {f"w.bad{i}.net" for i in range(0, 6000, 3)}
    assert bloom.blocked_hosts_by_filter(hosts, blocked.limit(0), bits=1 << 12).count() == 0


def test_transcript_pieces(spark):
    r = random.Random(2)
    text = {(c, t): " ".join("w" * r.randint(1, 9) for _ in range(r.randint(0, 12))) for c in range(6) for t in range(r.randint(1, 40))}
    a = [(c, t, x if c % 2 else None) for (c, t), x in text.items()]
    b = [(c, t, f" {x}\n") for (c, t), x in text.items() if c != 4]
    pieces = transcript_pieces(*(spark.createDataFrame(x, "conv_id long, turn int, text string").repartition(3) for x in (a, b)), size=100).collect()
    for c in range(6):
        whole = " ".join(x for (k, _), x in sorted(text.items()) if k == c)
        mine = sorted((p for p in pieces if p.conv_id == c), key=lambda p: p.piece_no)
        if c == 4 or not whole.strip():
            assert not mine
            continue
        assert " ".join(p.text for p in mine) == whole and {p.source for p in mine} == {"captions" if c % 2 else "fallback"}
        assert [whole[p.offset: p.offset + len(p.text)] for p in mine] == [p.text for p in mine] and [p.piece_no for p in mine] == list(range(1, len(mine) + 1))


def test_replayed_epoch_leaves_no_second_row(spark, tmp_path):
    from pagequality.streaming.stream import replace_epoch
    out = str(tmp_path / "sink")
    for epoch, n in ((0, 5), (1, 3), (1, 3), (0, 5)):
        replace_epoch(spark.range(n), out, epoch)
    assert spark.read.parquet(out).groupBy("epoch").count().orderBy("epoch").collect() == [(0, 5), (1, 3)]


def test_rank_list(spark, tmp_path):
    (tmp_path / "top.csv").write_text("1,Alpha.org\n2,beta.net\nx,bad\n")
    assert {(r.domain, r["rank"]) for r in rank_table(spark, str(tmp_path / "top.csv")).collect()} == {("alpha.org", 1), ("beta.net", 2), ("bad", None)}

from pyspark.sql import functions as F

from pagequality.operators.dedup import dedup_status, near_duplicate_status
from pagequality.operators.minhash import _shingles_of, shingle_count, shingle_text


def _members(spark, rows):
    """rows: (ord, prio, [bucket ids]) -> member rows with one band per bucket."""
    data = [(o, p, b, [b]) for o, p, bs in rows for b in bs]
    return spark.createDataFrame(data, "ord long, prio long, band int, bvals array<bigint>")


def _greedy(rows):
    kept, kept_buckets, out = [], set(), {}
    for o, _p, bs in sorted(rows, key=lambda r: r[1]):
        if kept_buckets & set(bs):
            out[o] = False
        else:
            out[o] = True
            kept_buckets |= set(bs)
    return out


def test_chain_keeps_ends(spark):
    # a(90) ~ b(80) ~ c(70), a and c unlike: keep a and c, drop b
    rows = [(1, 10, [1]), (2, 20, [1, 2]), (3, 30, [2])]
    st = {r.ord: (r.kept, r.dup_of) for r in near_duplicate_status(_members(spark, rows)).collect()}
    assert st == {1: (True, None), 2: (False, 1), 3: (True, None)}


def test_random_graphs_equal_sequential(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for o in range(300):
        rows.append((o, rnd.randrange(1000) * 1000 + o, rnd.sample(range(120), rnd.randint(1, 4))))
    got = {r.ord: r.kept for r in near_duplicate_status(_members(spark, rows)).collect()}
    assert got == _greedy(rows)


def test_short_texts_kept_and_ties(spark):
    same = "x" * 99
    long_text = "The same long text repeated for dedup purposes, well over one hundred characters in total length here."
    df = spark.createDataFrame([(1, same, 50), (2, same, 50), (3, long_text, 60), (4, long_text, 60),
                                (5, long_text.upper(), 40)], "id long, text string, score int")
    st = {r.id: (r.near_duplicate, r.dup_of) for r in dedup_status(df, "id", "text", "score").collect()}
    assert st[1] == (False, None) and st[2] == (False, None)  # short: always kept
    assert st[3] == (False, None) and st[4] == (True, 3)  # tie: lower ord kept
    assert st[5] == (True, 3)  # same text after lower-casing


def test_shingle_count_brute_force(spark):
    texts = ["Hello World", "abc", "", "  Mixed CASE text, with punctuation!  ", "ééééééé"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(shingle_count(F.col("t"))).collect()]
    want = [len(_shingles_of(t.lower().strip(), 5)) for t in texts]
    assert got == want


def test_shingle_count_on_table(spark):
    from sf_paths import SF001
    from pagequality.plans.queries import q_shingle_counts
    got = {r.doc_id: r.shingles for r in q_shingle_counts(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", shingle_text(F.col("text")).alias("s"))
    want = {r.doc_id: len(_shingles_of(r.s, 5)) for r in docs.collect()}
    assert got == want

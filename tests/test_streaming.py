import tempfile

from pyspark.sql import functions as F

from sf_paths import SF001
from pagequality.streaming.stream import first_seen_stream, read_stream, score_batch, score_stream


def test_stream_score_equals_batch(spark):
    out = tempfile.mkdtemp(prefix="pq-stream-out-")
    ck = tempfile.mkdtemp(prefix="pq-stream-ck-")
    schema = spark.read.parquet(f"{SF001}/documents.parquet").schema
    s = read_stream(spark, SF001, schema, file_glob="documents.parquet")
    q = score_stream(s, "doc_id", "text", out, ck, trigger_once=True)
    q.awaitTermination(300)
    streamed = {(r.doc_id, r.score, r.flags) for r in spark.read.parquet(out).collect()}
    batch = {(r.doc_id, r.score, r.flags)
             for r in score_batch(spark.read.parquet(f"{SF001}/documents.parquet"), "doc_id", "text").collect()}
    assert streamed == batch and len(batch) > 0


def test_first_seen_stream(spark):
    schema = spark.read.parquet(f"{SF001}/events.parquet").schema
    s = read_stream(spark, SF001, schema, file_glob="events.parquet")
    d = first_seen_stream(s, ["user_id", "event_type"], "ts", "100000 days")
    q = d.writeStream.format("memory").queryName("first_seen_events_t").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT user_id, event_type FROM first_seen_events_t")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    assert got.count() == ev.select("user_id", "event_type").distinct().count()
    assert got.groupBy("user_id", "event_type").count().where(F.col("count") > 1).count() == 0


def test_earlier_late_rows_win(spark, tmp_path):
    """Events in shuffled files: the stream's first sightings are those of the batch."""
    import random

    from pagequality.streaming.first_sighting import earliest_stream
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    rows = [tuple(r) for r in ev.collect()]
    random.Random(4).shuffle(rows)
    span = max(r[2] for r in rows) - min(r[2] for r in rows)
    end = max(r[2] for r in rows) + 3 * span
    src = tmp_path / "src"
    for k in range(4):
        spark.createDataFrame(rows[k::4], ev.schema).coalesce(1).write.mode("append").parquet(str(src))
    # two last rows far ahead: the watermark passes all timers
    for k in (1, 2):
        spark.createDataFrame([(None, "end", end + k * span, -k)], ev.schema).coalesce(1).write.mode("append").parquet(str(src))
    s = read_stream(spark, str(src), ev.schema, max_files_per_trigger=1)
    delay = int(span.total_seconds() * 1000) + 1000
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = earliest_stream(s, ["user_id", "event_type"], "ts", "event_id", delay_ms=delay).writeStream.format("parquet").option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start(out)
    assert q.awaitTermination(600)
    got = [tuple(r) for r in spark.read.parquet(out).where("event_type != 'end'").select("user_id", "event_type", "event_id").collect()]
    want = {}
    for u, t, ts, i in rows:
        want[u, t] = min(want.get((u, t), (ts, i)), (ts, i))
    assert sorted(got) == sorted((u, t, i) for (u, t), (_, i) in want.items())

"""Structured Streaming entry points.

* ``score_stream``: each micro-batch is scored with the batch operator
  (the keyed text statistics need joins and aggregates, which
  ``foreachBatch`` runs on the micro-batch as a static frame) and written to
  the sink's folder of its epoch, replacing what a failed attempt of the same epoch
  left there: a replayed batch leaves no second row.
* ``first_seen_stream``: first sighting of each key, with state bounded by a
  watermark (``dropDuplicatesWithinWatermark``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.html import extract_text
from ..functions.urls import canonical_url
from ..operators.score import with_quality
from ..params import DEFAULT, Params


def read_stream(spark: SparkSession, directory: str, schema, file_glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


def score_batch(batch: DataFrame, key: str, text_col: str, html_col: str | None = None,
                url_col: str | None = None, params: Params = DEFAULT) -> DataFrame:
    d = batch
    if html_col:
        d = d.withColumn("content", extract_text(F.col(html_col)))
        text_col = "content"
    q = with_quality(d, text_col, html_col=html_col, url_col=url_col, params=params)
    return q.select(key, F.col("quality.score").alias("score"), F.array_join("quality.flags", ",").alias("flags"),
                    F.col("quality.page_type").alias("page_type"))


def replace_epoch(scored: DataFrame, out_path: str, epoch: int) -> None:
    """Writes the rows of one epoch to ``out_path/epoch=<n>``, in place of earlier ones of that epoch; other epochs stay.
    Rows that a job has not committed are in no partition folder."""
    scored.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={epoch}")


def score_stream(stream: DataFrame, key: str, text_col: str, out_path: str, checkpoint: str,
                 html_col: str | None = None, url_col: str | None = None, params: Params = DEFAULT,
                 trigger_once: bool = False) -> StreamingQuery:
    def _write(batch: DataFrame, epoch: int) -> None:
        replace_epoch(score_batch(batch, key, text_col, html_col, url_col, params), out_path, epoch)

    w = stream.writeStream.foreachBatch(_write).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def first_seen_stream(stream: DataFrame, key_cols, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Drops later copies of a key seen within ``delay`` of event time
    (event time is read as a session-time-zone timestamp)."""
    s = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return s.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key_cols))


def url_first_seen_stream(stream: DataFrame, url_col: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """First sighting of each canonical URL (query-independent)."""
    s = stream.withColumn("canon", canonical_url(F.col(url_col)))
    return first_seen_stream(s, ["canon"], event_time, delay)

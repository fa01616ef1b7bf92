"""Transcripts from timed segments, and their source choice.

A transcript is its segments in order, joined by one space.  It is kept as
ordered segment rows plus per-conversation aggregates: the joined string is
assembled by the sink, so no conversation is collected into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .joins import sized_broadcast
from .ranking import with_offset
from .text_stats import token_array


def transcript_stats(segments: DataFrame, key: str = "conv_id", order: str = "turn",
                     text_col: str = "text") -> DataFrame:
    """Per transcript: segments, length of the space-joined text, words,
    first and last segment position."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return segments.groupBy(key).agg(
        F.count("*").cast("long").alias("segments"),
        (F.sum(F.length(t)) + F.count("*") - 1).cast("long").alias("chars"),
        F.sum(F.size(token_array(t))).cast("long").alias("words"),
        F.min(order).alias("first_turn"),
        F.max(order).alias("last_turn"),
    )


def transcript_segments(segments: DataFrame, key: str = "conv_id", order: str = "turn",
                        text_col: str = "text") -> DataFrame:
    """Segments in transcript order with the separator that precedes each
    one (empty for the first), ready for an ordered text sink."""
    first = segments.groupBy(key).agg(F.min(order).alias("_pq_first"))
    d = segments.join(first, key)
    sep = F.when(F.col(order) == F.col("_pq_first"), F.lit("")).otherwise(F.lit(" "))
    return d.select(key, order, F.concat(sep, F.coalesce(F.col(text_col), F.lit(""))).alias("piece")) \
        .orderBy(key, order)


def stripped_segments(segments: DataFrame, text_col: str = "text") -> DataFrame:
    """Second-provider form: each segment stripped of white space; empty ones stay."""
    return segments.withColumn(text_col, py_strip(F.coalesce(F.col(text_col), F.lit(""))))


def transcript_source(captions: DataFrame, fallback: DataFrame, key: str = "conv_id",
                      text_col: str = "text") -> DataFrame:
    """Which provider supplies each transcript: ``captions`` when it has any
    non-empty text, else ``fallback`` when that has, else none."""
    def present(df, name):
        return (df.groupBy(key).agg(F.max(F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("_m"))
                .select(key, (F.col("_m") > 0).alias(name)))
    ids = captions.select(key).union(fallback.select(key)).distinct()
    d = ids.join(present(captions, "_c"), key, "left").join(present(fallback, "_f"), key, "left")
    return d.select(key, F.when(F.coalesce("_c", F.lit(False)), F.lit("captions"))
                    .when(F.coalesce("_f", F.lit(False)), F.lit("fallback")).alias("source"))


def transcript_pieces(captions: DataFrame, fallback: DataFrame, key: str = "conv_id", order: str = "turn",
                      text_col: str = "text", size: int = 2000) -> DataFrame:
    """Whole transcripts as bounded pieces: ``key, source, piece_no, offset, text``.

    Captions, where they have any text, else the fallback's segments, each stripped of white space; transcripts without either have no
    rows.  Segments that start within the same ``size`` characters of the text make a piece; pieces in order, joined by a space, are the transcript,
    and ``offset`` is where a piece starts in it.  Null texts count as empty; segments of equal order go by their text."""
    source = transcript_source(captions, fallback, key, text_col).where("source is not null")
    source = sized_broadcast(source.select(F.col(key).alias("_pq_key"), "source"), 1_000_000)
    take = lambda df, name: df.select(F.col(key), F.col(order).alias("_pq_ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(name).alias("_pq_from"))
    rows = take(captions, "captions").unionByName(take(stripped_segments(fallback, text_col), "fallback"))
    rows = rows.join(source, (F.col(key).eqNullSafe(F.col("_pq_key"))) & (F.col("_pq_from") == F.col("source"))).select(key, "source", "_pq_ord", "text")
    rows = with_offset(rows, [key], [F.asc_nulls_last("_pq_ord"), F.asc("text")], F.length("text") + 1)
    rows = rows.groupBy(key, "source", F.floor(F.col("offset") / size).alias("_pq_part")).agg(
        F.array_sort(F.collect_list(F.struct("offset", "_pq_ord", "text"))).alias("x"))  # of a piece
    rows = rows.select(key, "source", "_pq_part", F.col("x")[0]["offset"].alias("offset"), F.array_join(F.col("x").getField("text"), " ").alias("text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_pq_part"))  # narrow but for the pieces of one transcript
    return rows.withColumn("piece_no", number).select(key, "source", "piece_no", "offset", "text")

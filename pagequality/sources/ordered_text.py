"""Ordered text files: one numbered set of files per document, written by sorted tasks.

A document (a digest, a session file) may be of any length, so no task holds one.  Its pieces are sorted over all tasks
by (document, order); each task writes the pieces that it has of a document to files below the document's folder.  Spark names
them by task and file number, so their names sort in the order of the text, and commits the folder as a whole: ``_SUCCESS`` appears
last, files of failed attempts never do.  Read back, the files of a document in name order are its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import sized_broadcast

#: Stands for a null document name in a folder's name.
NO_NAME = "(none)"


def write_ordered(pieces: DataFrame, path: str, name_col: str, order: list[Column], value_col: str,
                  separator: str = "\n", max_pieces: int = 10_000) -> None:
    """Writes ``value_col`` of each piece, followed by ``separator``, below ``path/name=...``; a file holds at most ``max_pieces``.

    ``path`` must not exist.  A null piece counts as empty."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # never null, so the writer keeps the order it is given instead of sorting by name anew
    d = pieces.withColumn("_pq_name", F.coalesce(F.col(name_col).cast("string"), F.lit(NO_NAME)))
    d = d.repartitionByRange(parts, "_pq_name", *order).sortWithinPartitions("_pq_name", *order)
    d.select(F.col("_pq_name").alias("name"), F.coalesce(F.col(value_col), F.lit("")).alias("value")).write.partitionBy("name").option(
        "lineSep", separator).option("maxRecordsPerFile", max_pieces).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``file`` (sorts in text order), ``value`` (the whole file) and ``modified`` of every file."""
    d = spark.read.schema("value string, name string").text(path, wholetext=True)
    return d.select("name", F.col("_metadata.file_name").alias("file"), "value", F.col("_metadata.file_modification_time").alias("modified"))


def read_lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """``name``, ``line_no`` (from 1) and ``line`` of the documents' texts: the pieces joined by ``separator``, split into lines.

    A file ends in a separator; the last one of a document isn't part of its text.  Lines are numbered
    by counting the lines of the files before."""
    files = read_files(spark, path)
    inner = separator.count("\n") - 1  # lines that a separator between two files adds, beside its line ends
    text = F.substring("value", 1, F.length("value") - len(separator))
    d = files.select("name", "file", F.split(text, "\n").alias("lines"))
    n = d.select("name", "file", F.size("lines").alias("n"))
    before = Window.partitionBy("name").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # rows are files
    at = F.coalesce(F.sum(F.col("n") + inner).over(before), F.lit(0))
    last = F.lead("file").over(Window.partitionBy("name").orderBy("file")).isNull()
    places = sized_broadcast(n.select(F.col("name").alias("_n"), F.col("file").alias("_f"), at.alias("_at"), last.alias("_last")), 1_000_000)
    d = d.join(places, (d["name"] == places["_n"]) & (d["file"] == places["_f"]))
    lines = F.when(F.col("_last"), F.col("lines")).otherwise(F.concat("lines", F.array_repeat(F.lit(""), inner))) if inner else F.col("lines")
    return d.select("name", "_at", F.posexplode(lines).alias("i", "line")).select("name", (F.col("_at") + F.col("i") + 1).cast("long").alias("line_no"), "line")

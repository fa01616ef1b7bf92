"""Search answers, session files and text sinks.

A session file holds one run: queries, mode, timestamp, a counter log and
its result entries.  At table scale the entries are written as parquet
partitioned by session (no per-session collection); the nested one-document
JSON form is offered for runs, whose size is bounded by the per-query limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import sized_broadcast
from ..operators.ranking import with_rank
from .ordered_text import read_lines, write_ordered

RESULT_FIELDS = (
    "url:string,title:string,content:string,engine:string,engines:array<string>,"
    "positions:array<int>,score:double,category:string,publishedDate:string"
)
ANSWER_SCHEMA = f"query string, number_of_results int, results array<struct<{RESULT_FIELDS}>>"

DETAILS_SCHEMA = (
    "struct<domain:struct<domain:string,tranco_rank:int>,"
    "html:struct<code_blocks:int,comment_sections:int,link_density:double,nav_ratio:double,ad_scripts:int>,"
    "text:struct<flesch_reading_ease:double,grade_level:double,ai_score:double,word_count:int,keyword_stuffing_ratio:double,"
    "repetitive_bigram_ratio:double,sentence_variance:double,slop_phrase_count:int>,relevance:double>"
)
QUALITY_SCHEMA = f"struct<score:int,flags:array<string>,details:{DETAILS_SCHEMA},page_type:string,relevance:double>"
ENTRY_SCHEMA = (
    f"struct<title:string,url:string,snippet:string,content:string,error:string,query:string,"
    f"html:string,quality:{QUALITY_SCHEMA}>"
)
SESSION_SCHEMA = (
    "queries array<string>, query string, mode string, timestamp string, "
    "log struct<blocked:int,scraped:int,errors:int,total:int,dedup_removed:int>, "
    f"results array<{ENTRY_SCHEMA}>"
)


def read_results(spark: SparkSession, path: str, page: int | None = None) -> DataFrame:
    """Search answers (one JSON document per file) as result rows; ``pos``
    keeps the answer's rank, a missing ``results`` gives no rows."""
    raw = spark.read.schema(ANSWER_SCHEMA).json(path, multiLine=True)
    raw = raw.withColumn("_file", F.col("_metadata.file_name"))
    rows = raw.select("query", "_file", F.posexplode_outer(F.coalesce("results", F.array())).alias("pos", "r"))
    out = rows.where(F.col("r").isNotNull()).select("query", "_file", (F.col("pos") + 1).alias("pos"), "r.*")
    if page is not None:
        out = out.withColumn("page", F.lit(page))
    return out


def read_sessions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per session with its file name and modification time.
    ``multi_line`` reads one pretty-printed document per file; set it to
    False for the JSON-lines form written by :func:`write_session_json`."""
    df = spark.read.schema(SESSION_SCHEMA).json(path, multiLine=multi_line)
    return df.select("*", F.col("_metadata.file_name").alias("file"),
                     F.col("_metadata.file_modification_time").alias("mtime"))


def session_entries(sessions: DataFrame) -> DataFrame:
    """Entries of every session with their list position ``ord``."""
    return sessions.select("file", "mtime", "queries", "query", "log",
                           F.posexplode_outer("results").alias("ord", "e")) \
        .where(F.col("e").isNotNull()).select("file", "mtime", "queries", "query", "log", "ord", "e.*")


def latest_session(sessions: DataFrame) -> DataFrame:
    """The newest session file by modification time (no rows if none)."""
    newest = sessions.agg(F.max_by("file", "mtime").alias("file"))
    return sessions.join(newest, "file", "left_semi")


def write_session_entries(entries: DataFrame, path: str, session_col: str = "session_id") -> None:
    """Scale form: entries as parquet, one folder per session."""
    entries.write.mode("overwrite").partitionBy(session_col).parquet(path)


def write_session_json(entries: DataFrame, headers: DataFrame, path: str,
                       session_col: str = "session_id", ord_col: str = "ord") -> None:
    """One JSON document per session: header fields plus ``results`` in
    ``ord`` order.  Meant for runs (bounded by the per-query limit)."""
    fields = [c for c in entries.columns if c not in (session_col, ord_col)]
    nested = (entries.groupBy(session_col)
              .agg(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("_o"), *fields))).alias("_r")))
    nested = nested.select(session_col, F.transform("_r", lambda r: r.dropFields("_o")).alias("results"))
    headers.join(nested, session_col, "left").write.mode("overwrite").json(path)


def write_session_documents(entries: DataFrame, headers: DataFrame, path: str, session_col: str = "session", ord_col: str = "ord") -> None:
    """One JSON document a session, of any length, as numbered files below ``path/name=<session>``.

    A document is a line with its header fields, a line for each entry in ``ord`` order and a closing line, written by
    :func:`write_ordered`; the files of a session in name order are valid JSON.  Sessions without a header row have
    their entries only, in ``{"results": [...]}``."""
    fields = [c for c in entries.columns if c not in (session_col, ord_col)]
    e = entries.select(F.col(session_col).alias("s"), F.col(ord_col).alias("o"), F.to_json(F.struct(*fields)).alias("json"))
    e = with_rank(e, ["s"], [F.asc_nulls_last("o"), F.asc("json")], "place")
    e = e.select("s", F.lit(1).alias("block"), "place", F.concat(F.when(F.col("place") > 1, ",").otherwise(""), "json").alias("line"))
    known = headers.select(F.col(session_col).alias("s"), F.to_json(F.struct(*[c for c in headers.columns if c != session_col])).alias("json"))
    heads = known.unionByName(entries.select(F.col(session_col).alias("s")).distinct().withColumn("json", F.lit(None).cast("string")))
    heads = heads.groupBy("s").agg(F.max("json").alias("json"))
    start = F.when(F.coalesce(F.length("json"), F.lit(0)) > 2, F.concat(F.expr("substr(json, 1, length(json) - 1)"), F.lit(","))).otherwise("{")
    ends = heads.select("s", F.explode(F.array(F.struct(F.lit(0).alias("block"), F.concat(start, F.lit('"results":[')).alias("line")),
                                               F.struct(F.lit(2).alias("block"), F.lit("]}").alias("line")))).alias("x"))
    ends = ends.select("s", "x.block", F.lit(0).cast("long").alias("place"), "x.line")
    write_ordered(e.unionByName(ends), path, "s", [F.asc("block"), F.asc("place")], "line")


def read_session_entries(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``header``, ``ord`` (from 0) and ``entry`` of the documents that :func:`write_session_documents` wrote."""
    lines = read_lines(spark, path)
    head = lines.where("line_no = 1").select(F.col("name").alias("_n"), F.from_json(F.concat("line", F.lit("]}")), SESSION_SCHEMA).alias("header"))
    # a header is one line, so the second line is the first entry; the closing line is no object
    rows = lines.where((F.col("line_no") > 1) & (F.col("line") != "]}"))
    rows = rows.select("name", (F.col("line_no") - 2).alias("ord"), F.from_json(F.regexp_replace("line", "^,", ""), ENTRY_SCHEMA).alias("entry"))
    return rows.join(sized_broadcast(head, 100_000), F.col("name") == F.col("_n")).select("name", "header", "ord", "entry")


def write_digest(digests: DataFrame, path: str, text_col: str = "digest") -> None:
    """Digest texts, one text file part per partition."""
    digests.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)

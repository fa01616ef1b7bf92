"""Blocklist and word-list sources.

Blocklist files use the browser-extension line grammar: ``*://*.host/*``
wildcard rules or bare host names.  Lines are parsed with two anchored
regular expressions, so a file of any size is parsed in parallel by the
text reader; the union with the built-in custom list is a ``distinct``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..params import DEFAULT, Params

# Fixed line patterns of the blocklist grammar.
WILDCARD_RULE = r"(?iU)^\*://\*?\.?([a-z0-9][\w.-]+\.[a-z]{2,})(/\*)?\z"
PLAIN_RULE = r"(?iU)^([a-z0-9][\w.-]+\.[a-z]{2,})\z"


def parse_blocklist_line(line: Column) -> Column:
    """Domain of one blocklist line, or NULL for comments, blanks and rules
    that are not whole-domain rules."""
    s = py_strip(line)
    ok = (F.length(s) > 0) & ~s.startswith("#") & ~s.startswith("!")
    wild = F.regexp_extract(s, WILDCARD_RULE, 1)
    plain = F.regexp_extract(s, PLAIN_RULE, 1)
    dom = F.coalesce(F.nullif(wild, F.lit("")), F.nullif(plain, F.lit("")))
    return F.when(ok, F.lower(dom))


def _missing(e: AnalysisException) -> bool:
    """Only a path that doesn't exist may stand for an empty list."""
    return e.getCondition() == "PATH_NOT_FOUND"


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Stripped non-blank lines whose unstripped text does not start with
    ``#``; ``(ord, value)`` keeps file order.  A missing path gives no rows."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], "ord long, value string")
    raw = raw.withColumn("ord", F.monotonically_increasing_id())
    kept = raw.where((py_strip(F.col("value")) != "") & ~F.col("value").startswith("#"))
    return kept.select("ord", py_strip(F.col("value")).alias("value"))


def custom_blocked(spark: SparkSession, params: Params = DEFAULT) -> DataFrame:
    """The built-in custom list (lower-cased; bypasses the line parser)."""
    return spark.createDataFrame([(d.lower(), "custom") for d in params.custom_blocked], "domain string, list string")


def read_blocklists(spark: SparkSession, paths=None, params: Params = DEFAULT) -> DataFrame:
    """``(domain, list)`` rows: every parsed line of every file plus the
    custom list.  ``list`` is the file name (or ``custom``)."""
    out = custom_blocked(spark, params)
    for p in paths or []:
        try:
            raw = spark.read.text(p)
        except AnalysisException as e:
            if not _missing(e):
                raise
            continue  # a missing file contributes nothing
        parsed = (raw.select(parse_blocklist_line(F.col("value")).alias("domain"),
                             F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("list"))
                  .where(F.col("domain").isNotNull()))
        out = out.unionByName(parsed)
    return out.distinct()


def blocked_domains(spark: SparkSession, paths=None, params: Params = DEFAULT) -> DataFrame:
    return read_blocklists(spark, paths, params).select("domain").distinct()


def blocklist_counts(lists: DataFrame) -> DataFrame:
    """Distinct domains per list plus the overall total (``list`` NULL)."""
    return lists.cube("list").agg(F.count_distinct("domain").alias("domains"))


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """Popularity list ``rank,domain`` CSV as ``(domain, rank)``."""
    return (spark.read.schema("rank int, domain string").csv(path)
            .select(F.lower(F.col("domain")).alias("domain"), "rank"))

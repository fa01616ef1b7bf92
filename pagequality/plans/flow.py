"""The flow from search rows to a digest on disk, as registered plans: results, fetched pages, entries, near
duplicates, log, ranks and files.  A query is a session; fetches fail by page id, so that whole batches are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as fu
from ..operators import digest as dg
from ..operators.alignment import refused, until_refused, zip_counts, zip_rows
from ..operators.bloom import blocked_hosts_by_filter
from ..operators.dedup import dedup_status
from ..operators.first_seen import search_results
from ..operators.interim import scratch_path, written
from ..operators.outcome import run_log, with_outcome
from ..operators.ranking import with_rank
from ..operators.score import with_quality
from ..operators.suffixes import with_domains
from ..operators.transcripts import transcript_pieces
from ..params import DEFAULT
from ..sources.blocklists import custom_blocked
from ..sources.ordered_text import read_lines
from ..sources.sessions import read_session_entries, write_session_documents
from ..sources.tables import read_table
from . import queries as Q
from .varied import varied

#: More results a query than by default, so that runs have several batches.
LIMIT = 30


def results(spark, sf) -> DataFrame:
    return search_results(Q._classified(spark, sf), DEFAULT, LIMIT).select("query", "page", "pos", "page_id", "url")


def fetches(pages: DataFrame) -> DataFrame:
    """Every page as it would come back: by id some are refused, some raise, some fail."""
    k = F.col("page_id")
    is_refused, raised = F.floor(k / 12) % 3 == 1, k % 13 == 5
    failed = F.coalesce(F.length("html"), F.lit(0)) == 0
    return pages.select(
        "page_id", F.when(~is_refused & ~raised & ~failed, F.col("html")).alias("html"),
        (~is_refused & ~raised & ~failed).alias("success"), raised.alias("is_exception"),
        F.when(raised, "Timeout after 403 pages").when(is_refused, "HTTP 403 Forbidden").when(failed, "Connection reset").alias("error_message"))


def fetched(spark, sf, wanted: DataFrame) -> DataFrame:
    """The pages that each run got before it stopped, in fetch order, without their addresses."""
    tried = wanted.select("query", F.col("page").alias("f_page"), F.col("pos").alias("f_pos"), "page_id").join(fetches(read_table(spark, sf, "pages")), "page_id")
    tried = tried.withColumn("refused", refused(F.col("success"), F.col("error_message"), F.col("is_exception")))
    narrow = with_rank(tried.select("query", "f_page", "f_pos", "refused"), ["query"], [F.asc("f_page"), F.asc("f_pos")], "position")
    made = until_refused(narrow, ["query"]).select("query", "f_page", "f_pos")
    return tried.join(made, ["query", "f_page", "f_pos"], "left_semi").drop("page_id", "refused")


def entries(spark, sf) -> DataFrame:
    """Results with the pages at their positions, outcomes and scores."""
    r = results(spark, sf)
    order = lambda *c: [F.asc(x) for x in c]
    z = zip_rows(r, fetched(spark, sf, r), ["query"], order("page", "pos"), order("f_page", "f_pos")).drop("f_page", "f_pos")
    return with_quality(with_outcome(z), "content", html_col="html", url_col="url")


def q_positional_join(spark, sf):
    e = entries(spark, varied(sf))
    return e.select("query", "position", "page_id", "outcome", "error", F.col("is_blocked_fetch").alias("refused"), F.length("content").cast("long").alias("content_len"))


def q_fetch_counts(spark, sf):
    sf = varied(sf)
    r = results(spark, sf)
    return zip_counts(r, fetched(spark, sf, r), ["query"])


def q_flow_log(spark, sf):
    sf = varied(sf)
    r = results(spark, sf)
    e = written(entries(spark, sf).select("query", "page", "pos", "outcome", "is_blocked_fetch", "content", F.when(
        F.coalesce(F.length("html"), F.lit(0)) > 0, F.col("quality.score")).alias("score")), "flow-entries")
    e = with_rank(e, [], [F.asc("query"), F.asc("page"), F.asc("pos")], "ord")
    e = written(e, "flow-ordered")
    dups = dedup_status(e, "ord", "content", "score", scope_col="query")
    e = e.drop("content").join(dups.select("ord", "near_duplicate"), "ord")
    rows = r.select("query", "page", "pos").join(e.withColumn("fetched", F.lit(True)), ["query", "page", "pos"], "left")
    rows = rows.withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    return run_log(rows, "query")


def q_digest_rank(spark, sf):
    r = dg.digest_rank(Q.doc_entries(spark, sf))
    return r.select("session", F.col("ord").cast("long").alias("ord"), F.round("sort_key", Q.R).alias("sort_key"), "rank")


def q_digest_files(spark, sf):
    """Digests written as numbered files and read back, line by line."""
    path = scratch_path(spark, "digests")
    e = Q.doc_entries(spark, sf).select("session", "ord", "title", "content", "score", "relevance", "page_type")
    # scored once: the digest counts and renders the entries, and ranges are sampled before they are sorted
    dg.write_digests(written(e, "digest-entries"), Q.doc_sessions(spark, sf), path)
    return read_lines(spark, path, separator="\n\n").select(F.col("name").alias("session"), "line_no", "line")


def q_session_files(spark, sf):
    """Documents written as session files, entry by entry, and read back."""
    path = scratch_path(spark, "sessions")
    d = Q.scored_docs(spark, sf)
    e = d.select(F.col("source").alias("session"), F.col("doc_id").alias("ord"), F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"),
                 F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/doc/"), F.col("doc_id").cast("string")).alias("url"),
                 F.col("text").alias("content"), F.struct("quality.*", F.struct(F.struct(
                     F.col("quality_details.text.word_count").alias("word_count"), F.col("quality_details.text.slop_phrase_count").alias("slop_phrase_count")).alias("text")).alias("details")).alias("quality"))
    s = Q.doc_sessions(spark, sf).select("session", "queries", F.lit("search").alias("mode"), F.struct(F.col("total").cast("int").alias("total"), F.lit(0).alias("dedup_removed")).alias("log"))
    # scored once: sessions are listed, and ranges are sampled before they are sorted
    write_session_documents(written(e, "session-entries"), s, path)
    back = read_session_entries(spark, path)
    return back.select(F.col("name").alias("session"), F.col("header.mode").alias("mode"), F.array_join("header.queries", "|").alias("queries"),
                       F.col("header.log.total").cast("long").alias("total"), F.col("ord").cast("long").alias("ord"), "entry.title", "entry.url",
                       F.md5(F.col("entry.content").cast("binary")).alias("content_md5"), F.col("entry.quality.score").cast("long").alias("score"),
                       F.array_join("entry.quality.flags", ",").alias("flags"), F.col("entry.quality.details.text.word_count").cast("long").alias("word_count"))


def _hosts(spark, sf) -> DataFrame:
    h = read_table(spark, varied(sf), "pages", ["page_id", "url"]).select("page_id", fu.url_host(fu.canonical_url(F.col("url"))).alias("host"))
    return written(h, "hosts")  # narrow, and read several times


def host_rules(hosts: DataFrame) -> DataFrame:
    """Suffix rules that the hosts give: their last labels, two of them with wildcards, and exceptions from one of these."""
    two = F.expr("array_join(slice(split(host, '[.]'), -2, 2), '.')")
    h = hosts.where("size(split(host, '[.]')) >= 2").select(two.alias("two"), F.substring_index("host", ".", -1).alias("last")).distinct()
    plain = h.select(F.col("last").alias("rule"))
    wild = h.where("last IN ('org', 'uk')").select(F.concat(F.lit("*."), "last"))
    but = h.where("last = 'org' AND length(two) >= 11").select(F.concat(F.lit("!"), "two"))
    return plain.union(wild).union(but).distinct()


def q_suffix_domains(spark, sf):
    h = _hosts(spark, sf)
    return with_domains(h, host_rules(h)).select("page_id", "host", "domain", "name", "suffix")


def long_blocklist(spark, sf, hosts: DataFrame) -> DataFrame:
    """The custom list, a made-up shop of every customer, and some of the pages' own hosts."""
    shops = read_table(spark, sf, "customer", ["c_custkey"]).select(F.concat(F.lit("shop"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain"))
    own = hosts.where("length(host) % 3 = 0 AND host != ''").select("host").distinct()
    return custom_blocked(spark).select("domain").union(shops).union(own).distinct()


def q_blocked_hosts(spark, sf):
    h = _hosts(spark, sf)
    found = blocked_hosts_by_filter(h, long_blocklist(spark, sf, h)).withColumn("is_blocked", F.lit(True))
    return h.select("host").distinct().join(found, "host", "left").select("host", F.coalesce("is_blocked", F.lit(False)).alias("is_blocked"))


def providers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two providers of transcripts: by conversation, captions are blank, or the fallback has nothing."""
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    blank = F.col("conv_id") % 3 == 1
    return c.withColumn("text", F.when(~blank, F.col("text"))), c.where(F.col("conv_id") % 7 != 0).withColumn("text", F.concat(F.lit("  "), "text", F.lit("\n")))


def q_transcript_pieces(spark, sf):
    return transcript_pieces(*providers(spark, sf), size=300).select(
        "conv_id", "source", F.col("piece_no").cast("long").alias("piece_no"), F.col("offset").cast("long").alias("offset"), "text")


QUERIES = {
    "suffix_domains": q_suffix_domains,
    "blocked_hosts": q_blocked_hosts,
    "transcript_pieces": q_transcript_pieces,
    "positional_join": q_positional_join,
    "fetch_counts": q_fetch_counts,
    "flow_log": q_flow_log,
    "digest_rank": q_digest_rank,
    "digest_files": q_digest_files,
    "session_files": q_session_files,
}

"""WARC archives: write, read back, reassemble segments, decode chunked framing.

Writing: each page becomes a response record, or a revisit of the page with the smallest id among those
with the same payload.  A payload is framed in HTTP chunks and, if its block is large, spread over segments:
the first record has WARC-Segment-Number 1, continuation records name it as origin, the last one states the
total length.  Spark's text sink writes the records (line separator CRLF, so each ends with CRLF CRLF).

Reading: Spark's text source splits archives at the version line, which the writer never lets stand inside a
block (a chunk ends in the middle of it).  Blocks of one origin are put in order by segment number and
joined; the total length and every chunk size are verified.  Records of a single segment skip the shuffle.

Groups are the segments of one payload; copies of a payload meet only as (digest, length, smallest id).

Defined cases: a null html is an empty payload; a record is named by its page_id and payload digest, so rows
that share an id keep apart and equal rows come back once each; a null page_id is always a response; a record
whose segments are missing or whose length or digest is another than stated has complete = false and a null payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

VERSION = "WARC/1.1\r\n"
CRLF = b"\r\n"


@dataclass(frozen=True)
class WarcParams:
    #: Payloads of at least so many bytes are written once; smaller ones are all responses.
    min_revisit_bytes: int = 0
    segment_bytes: int = 32 * 1024
    chunk_bytes: int = 8 * 1024
    date: str = "2024-01-01T00:00:00Z"
    compression: str = "gzip"


DEFAULT = WarcParams()


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def frame(payload: bytes, chunk: int) -> bytes:
    """HTTP chunked framing; a chunk also ends inside any version line, so that it never stands whole in a block, and none
    ends like a version line, which the chunk's CRLF would complete."""
    out, start, n = [], 0, len(payload)
    cuts = [m.start() + 9 for m in re.finditer(re.escape(VERSION.encode()), payload)]
    while start < n:
        end = min(start + chunk, n)
        while cuts and cuts[0] <= start:
            cuts.pop(0)
        if cuts and cuts[0] < end:
            end = cuts[0]
        if payload.endswith(VERSION[:-2].encode(), start, end):
            end -= 1
        out += [b"%x\r\n" % (end - start), payload[start:end], CRLF]
        start = end
    return b"".join(out) + b"0\r\n\r\n"


def unframe(block: bytes) -> bytes | None:
    """Inverse of chunked framing; None if the framing doesn't hold."""
    out, at = [], 0
    while True:
        eol = block.find(CRLF, at)
        if eol < 0:
            return None
        try:
            size = int(block[at:eol].split(b";")[0], 16)
        except ValueError:
            return None
        at = eol + 2
        if size == 0:
            return b"".join(out)
        if block[at + size: at + size + 2] != CRLF:
            return None
        out.append(block[at: at + size])
        at += size + 2


def segments(block: bytes, size: int) -> list[bytes]:
    """``block`` in parts of up to ``size`` bytes; none ends like a version line, which the record's CRLF would complete."""
    out, at = [], 0
    while at < len(block):
        part = block[at: at + size]
        if part.endswith(VERSION[:-2].encode()) and len(part) > 1:
            part = part[:-1]
        out.append(part)
        at += len(part)
    return out


def records(key: str, url: str | None, payload: bytes, first: str | None, p: WarcParams) -> Iterator[bytes]:
    """The records of one page, each without its version line and last CRLF."""
    digest = sha1_base32(payload)
    name = lambda k, n=1: f"<urn:page:{k}:{digest}>" if n == 1 else f"<urn:page:{k}:{digest}:{n}>"
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(key)}", f"WARC-Date: {p.date}",
            f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '').replace(VERSION.strip(), 'WARC%2F1.1')}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http;msgtype=response"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

    def record(lines, block):
        return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + CRLF

    if first is not None:
        yield record([*head, f"WARC-Refers-To: {name(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"], http + CRLF)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + frame(payload, p.chunk_bytes)
    parts = segments(block, p.segment_bytes)
    if len(parts) == 1:
        yield record(head, block)
        return
    yield record([*head, "WARC-Segment-Number: 1"], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = [f"WARC-Segment-Total-Length: {len(block)}"] if n == len(parts) else []
        yield record(["WARC-Type: continuation", f"WARC-Record-ID: {name(key, n)}", f"WARC-Date: {p.date}", f"WARC-Segment-Origin-ID: {name(key)}",
                      f"WARC-Segment-Number: {n}", *total], part)


def plan_records(pages: DataFrame, p: WarcParams = DEFAULT, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """id, url, html and first (the id that holds the same payload, null for a response)."""
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    narrow = d.select("id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("bytes"))
    firsts = narrow.where((F.col("bytes") >= p.min_revisit_bytes) & F.col("id").isNotNull()).groupBy("sha", "bytes").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = narrow.join(firsts, ["sha", "bytes"]).where("id > first").select(F.col("id").alias("rid"), "sha", "first").distinct()
    return d.join(again, (F.col("id") == F.col("rid")) & (F.sha1(F.col("html").cast("binary")) == F.col("sha")), "left").select("id", "url", "html", "first")


def write(pages: DataFrame, path: str, p: WarcParams = DEFAULT, **cols) -> None:
    """Archives of ``pages`` as files in the folder ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = [VERSION.encode() + r for r in records(i, url, html.encode(), first, p)]
                yield pa.record_batch([pa.array(rows, pa.binary())], ["record"])

    rendered = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    out = plan_records(pages, p, **cols).select(rendered, "url", "html", F.col("first").cast("string")).mapInArrow(run, "record binary")
    # bytes pass through the text sink as they are
    out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", p.compression).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    get = lambda h, k: h.get(k, "").strip() or None
    plain = lambda x: x and re.sub(r"^<(.*)>$", r"\1", x)
    for b in batches:
        rows = []
        for raw in b.column(0).to_pylist():
            head, sep, rest = raw.partition(b"\r\n\r\n")
            if not sep:
                continue
            h = dict(x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n") if ":" in x)
            h = {k.strip().lower(): v for k, v in h.items()}
            length = int(get(h, "content-length") or -1)
            whole = 0 <= length <= len(rest)
            number = int(get(h, "warc-segment-number") or 0)
            rows.append({
                "origin": plain(get(h, "warc-segment-origin-id") or get(h, "warc-record-id")), "kind": get(h, "warc-type"), "number": number,
                "total": int(get(h, "warc-segment-total-length") or -1), "digest": (get(h, "warc-payload-digest") or "").removeprefix("sha1:") or None,
                "refers": plain(get(h, "warc-refers-to")), "block": rest[:length] if whole else None})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("origin", pa.string()), ("kind", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())]))


PARSED = "origin string, kind string, number int, total long, digest string, refers string, block binary"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a record (null where one is missing) to its payload, with everything verified."""
    for b in batches:
        payloads, lengths, digests, ok = [], [], [], []
        for parts, total, stated in zip(*(b.column(n).to_pylist() for n in ("blocks", "total", "digest")), strict=True):
            payload = None
            if parts is not None and all(x is not None for x in parts):
                block = b"".join(parts)
                if total < 0 or total == len(block):
                    head, _, body = block.partition(b"\r\n\r\n")
                    chunked = b"transfer-encoding: chunked" in head.lower()
                    payload = unframe(body) if chunked else body
            digest = None if payload is None else sha1_base32(payload)
            if stated and digest != stated:
                payload = digest = None
            payloads.append(payload)
            digests.append(digest)
            lengths.append(None if payload is None else len(payload))
            ok.append(payload is not None)
        yield pa.record_batch([b.column("origin"), pa.array(payloads, pa.binary()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), pa.array(ok)],
                              ["origin", "payload", "bytes", "digest", "complete"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in ``path``, continuations included."""
    raw = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("raw"))
    return raw.where(F.octet_length("raw") > 0).mapInArrow(_parse, PARSED)


def reassemble(recs: DataFrame) -> DataFrame:
    """origin, payload, bytes, digest, complete of every response, its segments joined in order."""
    single = recs.where("kind = 'response' and number = 0").select(
        "origin", F.array("block").alias("blocks"), F.lit(-1).cast("long").alias("total"), "digest")
    many = recs.where("kind in ('response', 'continuation') and number > 0").groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("number", "block"))).alias("s"), F.max("total").alias("total"), F.max("digest").alias("digest"),
        F.max("number").alias("last"), F.greatest(F.count_if(F.col("number") == 1), F.lit(1)).alias("copies"))
    whole = (F.size("s") == F.col("last")) & (F.col("total") >= 0)
    many = many.select("origin", F.when(whole, F.col("s.block")).alias("blocks"), "total", "digest",
                       F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
    return single.unionByName(many).mapInArrow(_decode, "origin string, payload binary, bytes long, digest string, complete boolean")


def read(spark: SparkSession, path: str) -> DataFrame:
    """origin, record_type, refers, bytes and digest of the full payload, payload (null for revisits), complete."""
    recs = read_records(spark, path)
    whole = reassemble(recs)
    revisits = recs.where("kind = 'revisit'").select("origin", "refers", F.col("digest").alias("stated"))
    held = whole.select(F.col("origin").alias("refers"), "bytes", "digest", "complete").distinct()
    back = revisits.join(held, "refers", "left").select(
        "origin", F.lit("revisit").alias("record_type"), "refers", "bytes", "digest", F.lit(None).cast("binary").alias("payload"),
        F.coalesce(F.col("complete") & (F.col("digest") == F.col("stated")), F.lit(False)).alias("complete"))
    return whole.select("origin", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers"), "bytes", "digest", "payload", "complete").unionByName(back)


def round_trip(pages: DataFrame, params: WarcParams = DEFAULT) -> DataFrame:
    """Writes archives of ``pages`` to the shared folder, reads them back, and returns a row for each page."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, params)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda c: F.regexp_extract(c, r"^urn:page:(.*):[A-Z2-7]{32}$", 1).try_cast(kind)
    return read(spark, path).select(
        page("origin").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        page("refers").alias("refers_to"), "complete")

"""URL projections (Column -> Column).  All are JVM-side string/regex
expressions, so they stay inside whole-stage codegen and never shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def canonical_url(url: Column) -> Column:
    """Everything before the first ``?`` or ``#`` of a line; no other folding."""
    return F.regexp_replace(url, r"(?d)[?#].*", "")


def rewrite_url(url: Column, params: Params = DEFAULT) -> Column:
    """Plain substring replacement for every rewrite rule, in order (fetch only)."""
    out = url
    for src, dst in params.url_rewrites:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def url_extension(canon: Column) -> Column:
    """Lower-cased extension of the last path piece, ``splitext`` style.

    Leading dots of the last piece do not start an extension; a trailing
    ``/`` means no extension.
    """
    return F.lower(F.regexp_extract(canon, r"[^./][^/]*(\.[^./]*)\z", 1))


def url_host(url: Column) -> Column:
    """Second piece of a split on ``//`` up to the first ``/``, lower-cased,
    one leading ``www.`` removed; empty when there is no ``//``.  Port and
    user info are kept."""
    after = F.get(F.split(url, "//"), 1)
    host = F.lower(F.get(F.split(after, "/"), 0))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def listing_host(url: Column) -> Column:
    """Host as shown by the page listing: no ``www`` strip, no lower-casing."""
    return F.when(F.instr(url, "//") > 0, F.get(F.split(F.get(F.split(url, "//"), 1), "/"), 0)).otherwise(F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent down to the bare top-level label."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    )


def page_type(url: Column, params: Params = DEFAULT) -> Column:
    """First label (in rule order) whose pattern occurs in the lower-cased URL
    before its first ``?``; ``unknown`` otherwise."""
    path = F.substring_index(F.lower(url), "?", 1)
    expr = None
    for label, patterns in params.page_types:
        cond = None
        for p in patterns:
            c = F.instr(path, p) > 0
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("unknown"))


def is_video_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://(www\.)?(youtube\.com|youtu\.be)/"), F.lit(False))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/)([\w-]{11})", 1), F.lit(""))


def slugify(text: Column, params: Params = DEFAULT) -> Column:
    """lower -> non ``[a-z0-9]`` runs to ``-`` -> strip ``-`` -> first N chars."""
    s = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+\z", "")
    return F.substring(s, 1, params.max_slug_length)


def session_name(mode: Column, queries: Column, params: Params = DEFAULT) -> Column:
    """``{mode}-{slug}.json`` for the space-joined queries."""
    return F.concat(mode, F.lit("-"), slugify(F.array_join(queries, " "), params), F.lit(".json"))


def session_query(query: Column, queries: Column) -> Column:
    """The session's ``query``, else its ``queries`` joined by ``", "``."""
    return F.coalesce(F.nullif(query, F.lit("")), F.array_join(queries, ", "), F.lit(""))

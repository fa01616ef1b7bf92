"""Domain reputation signals (Column -> Column).

The registered-domain split is a longest-suffix match of the host's trailing
labels against a suffix set held as a literal ``IN`` set (a hash set inside
the expression), so it needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def netloc_host(url: Column) -> Column:
    """Host of a URL for the suffix split: scheme and ``//`` removed, cut at
    ``/ ? #``, user info and port dropped, trailing dot removed, lower."""
    s = F.regexp_replace(url, r"^\s*([A-Za-z0-9+.-]+:)?//", "")
    s = F.regexp_extract(s, r"^([^/?#]*)", 1)
    s = F.regexp_replace(s, r"^.*@", "")
    s = F.regexp_replace(s, r":[0-9]*\z", "")
    s = F.regexp_replace(s, r"\.+\z", "")
    return F.lower(s)


def registered_domain(url: Column, params: Params = DEFAULT) -> Column:
    """``struct(domain, name, suffix)``: ``domain`` is ``name.suffix`` or ''
    when the host has no known suffix, is an IP address, or is a bare suffix."""
    host = netloc_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    max_k = max(len(s.split(".")) for s in params.public_suffixes)
    suffix_set = list(params.public_suffixes)
    # longest k first
    k_expr = None
    for k in range(max_k, 0, -1):
        cand = F.array_join(F.slice(labels, -k, k), ".")
        cond = (n >= k) & cand.isin(suffix_set)
        k_expr = F.when(cond, F.lit(k)) if k_expr is None else k_expr.when(cond, F.lit(k))
    is_ip = host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\z") | (F.instr(host, ":") > 0)
    k = F.when(is_ip | (host == ""), F.lit(0)).otherwise(k_expr.otherwise(F.lit(0)))
    return F.struct(host.alias("host"), labels.alias("labels"), n.alias("n"), k.alias("k"))


def split_domain(rd: Column) -> Column:
    """Finish :func:`registered_domain` once its struct is materialised."""
    n, k, labels = rd["n"], rd["k"], rd["labels"]
    suffix = F.when(k > 0, F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")).otherwise(F.lit(""))
    name = F.when((k > 0) & (n > k), F.element_at(labels, F.greatest(n - k, F.lit(1)))).otherwise(F.lit(""))
    domain = F.when((name != "") & (suffix != ""), F.concat(name, F.lit("."), suffix)).otherwise(F.lit(""))
    return F.struct(domain.alias("domain"), name.alias("name"), suffix.alias("suffix"))


def domain_points(dom: Column, rank: Column, params: Params = DEFAULT) -> Column:
    """Points, flags and details from ``struct(domain, name, suffix)`` and a
    popularity rank (-1 when unknown)."""
    domain, name, suffix = dom["domain"], dom["name"], dom["suffix"]
    bad = domain == ""
    r = F.coalesce(rank, F.lit(-1))
    p_rank = (F.when(r <= 0, 0).when(r <= 1000, 15).when(r <= 10000, 10)
              .when(r <= 100000, 5).otherwise(2))
    f_rank = (F.when(r <= 0, F.lit(None)).when(r <= 1000, F.lit("top_1k"))
              .when(r <= 10000, F.lit("top_10k")).when(r <= 100000, F.lit("top_100k")))
    hi = suffix.isin(list(params.high_quality_tlds))
    lo = suffix.isin(list(params.low_quality_tlds))
    p_tld = F.when(hi, 5).when(lo, -10).otherwise(0)
    f_tld = F.when(hi, F.lit("institutional_tld")).when(lo, F.lit("junk_tld"))
    hyph = (F.length(name) - F.length(F.replace(name, F.lit("-"), F.lit("")))) >= 3
    long_ = F.length(name) > 30
    year = name.rlike(r"20[2-3][0-9]")
    seo = F.array_sort(F.array_intersect(F.array_distinct(F.split(F.lower(name), "-")),
                                         F.array(*[F.lit(w) for w in params.seo_keywords])))
    has_seo = F.size(seo) > 0
    points = (p_rank + p_tld + F.when(hyph, -10).otherwise(0) + F.when(long_, -5).otherwise(0)
              + F.when(year, -8).otherwise(0) + F.when(has_seo, -8).otherwise(0))
    flags = F.array_compact(F.array(
        f_rank, f_tld,
        F.when(hyph, F.lit("hyphen_stuffed")),
        F.when(long_, F.lit("long_domain")),
        F.when(year, F.lit("year_in_domain")),
        F.when(has_seo, F.concat(F.lit("seo_domain:"), F.array_join(seo, ","))),
    ))
    return F.struct(
        F.when(bad, F.lit(0)).otherwise(points).alias("points"),
        F.when(bad, F.array(F.lit("bad_url"))).otherwise(flags).alias("flags"),
        domain.alias("domain"),
        F.when(bad, F.lit(None).cast("int")).otherwise(r.cast("int")).alias("tranco_rank"),
    )

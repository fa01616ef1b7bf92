"""A Bloom filter built by Spark, tested before the exact join with a long blocklist.

Bits are set by an aggregate: every domain gives a few (word, bit) pairs, ``bit_or`` sums them up by word, and the words make
one array of fixed size.  The test is a column over that array, so only hosts that may be blocked reach the shuffle of the exact
join; the filter has no false negatives, so the join's result is that of the join alone.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_suffixes
from .interim import written

#: Bits set for each domain.
HASHES = 5
#: 2^23 bits, one MB: below one false positive in a hundred up to some 800,000 domains.
BITS = 1 << 23


def _places(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def bloom_filter(domains: DataFrame, col: str = "domain", bits: int = BITS) -> DataFrame:
    """One row with ``words``: an array of ``bits / 64`` longs."""
    set_bits = domains.select(F.explode(F.array(*_places(F.col(col), bits))).alias("bit"))
    words = set_bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63L as int))")).alias("word"))
    every = domains.sparkSession.range(bits // 64).select(F.col("id").alias("at"))
    every = every.join(words, "at", "left").select("at", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    parts = every.groupBy(F.shiftright("at", 10).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).getField("word").alias("words"))
    return parts.agg(F.flatten(F.array_sort(F.collect_list(F.struct("part", "words"))).getField("words")).alias("words"))


def may_contain(words: Column, value: Column, bits: int = BITS) -> Column:
    """False only where ``value`` was not among the filter's domains; ``words`` is the filter's array, as a scalar."""
    hit = lambda b: F.get(words, F.shiftright(b, 6).cast("int")).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))) != 0
    return reduce(and_, [hit(b) for b in _places(value, bits)])


def candidate_parents(hosts: DataFrame, blocked: DataFrame, host_col: str = "host", bits: int = BITS) -> DataFrame:
    """``host, domain``: the hosts' parents that the filter lets through to the exact join."""
    words = written(bloom_filter(blocked.select("domain"), "domain", bits), "bloom").scalar()
    h = hosts.select(F.col(host_col).alias("host")).where(F.col("host") != "").distinct()
    parents = h.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    return parents.where(may_contain(words, F.col("domain"), bits))


def blocked_hosts_by_filter(hosts: DataFrame, blocked: DataFrame, host_col: str = "host", bits: int = BITS) -> DataFrame:
    """Distinct hosts that are blocked themselves or by a parent, for lists too long to broadcast."""
    parents = candidate_parents(hosts, blocked, host_col, bits)
    return parents.join(blocked.select("domain").distinct(), "domain", "left_semi").select("host").distinct()

"""Registered domains by a table of public-suffix rules, as joins.

Rules are plain (``co.uk``), wildcards (``*.ck``: any one label more) or exceptions (``!www.ck``: the rule without its
first label, before all others); otherwise the longest rule wins.  Each distinct host is taken apart into its
parents once, the parents meet the rules by an equi-join (broadcast only while the rules are few), and a combined aggregate per
host keeps the best rule: an integer, so nothing is collected per host.  The rows get the result back by their host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import sized_broadcast


def parsed_rules(rules: DataFrame, col: str = "rule") -> DataFrame:
    """``base``, ``kind`` (0 plain, 1 wildcard, 2 exception) and ``more``, the labels that the suffix has beyond the base.
    Blank rules and ``//`` comments are left out."""
    r = rules.select(F.lower(F.trim(F.col(col))).alias("r")).where("r != '' and not startswith(r, '//')").distinct()
    kind = F.when(F.startswith("r", F.lit("!")), 2).when(F.startswith("r", F.lit("*.")), 1).otherwise(0)
    return r.select(F.regexp_replace("r", r"^(!|\*\.)", "").alias("base"), kind.alias("kind"),
                    F.when(kind == 2, -1).when(kind == 1, 1).otherwise(0).alias("more"))


def host_domains(hosts: DataFrame, rules: DataFrame, host_col: str = "host", rule_col: str = "rule", max_rules: int = 100_000) -> DataFrame:
    """``host, domain, name, suffix`` of every distinct host; empty strings where no rule fits, for addresses of four numbers and bare suffixes."""
    h = hosts.select(F.lower(F.coalesce(F.col(host_col), F.lit(""))).alias("host")).distinct()
    named = h.where((F.col("host") != "") & ~F.col("host").rlike(r"^[0-9]+(\.[0-9]+){3}\z") & ~F.contains("host", F.lit(":")))
    labels = F.split("host", r"\.")
    parents = named.select("host", F.posexplode(labels).alias("at", "label"), F.size(labels).alias("n"), labels.alias("labels"))
    parents = parents.select("host", "n", (F.col("n") - F.col("at")).alias("k"), F.expr("array_join(slice(labels, at + 1, n - at), '.')").alias("base"))
    met = parents.join(sized_broadcast(parsed_rules(rules, rule_col), max_rules), "base").withColumn("k", F.col("k") + F.col("more"))
    met = met.where("k <= n and k >= 1")  # a wildcard needs its label
    best = met.groupBy("host").agg(F.max(F.when(F.col("kind") == 2, F.lit(1 << 20)).otherwise(0) + F.col("k")).alias("k"))
    best = best.select(F.col("host").alias("_h"), (F.col("k") % F.lit(1 << 20)).cast("int").alias("k"))
    d = h.join(best, F.col("host") == F.col("_h"), "left").withColumn("k", F.coalesce("k", F.lit(0))).withColumn("labels", labels)
    n = F.size("labels")
    suffix = F.when(F.col("k") > 0, F.expr("array_join(slice(labels, size(labels) - k + 1, k), '.')")).otherwise("")
    name = F.when((F.col("k") > 0) & (n > F.col("k")), F.get("labels", n - F.col("k") - 1)).otherwise("")
    return d.select("host", F.when(name != "", F.concat(name, F.lit("."), suffix)).otherwise("").alias("domain"), name.alias("name"), suffix.alias("suffix"))


def with_domains(df: DataFrame, rules: DataFrame, host_col: str = "host", rule_col: str = "rule") -> DataFrame:
    """Adds ``domain, name, suffix`` by the host; rows without a host get empty strings."""
    found = sized_broadcast(host_domains(df, rules, host_col, rule_col).withColumnRenamed("host", "_pq_h"), 1_000_000)
    return df.join(found, F.lower(F.coalesce(F.col(host_col), F.lit(""))) == F.col("_pq_h"), "left").drop("_pq_h")

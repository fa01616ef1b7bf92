"""Quality classifier by hierarchical empirical Bayes.

Evidence of a document: a naive Bayes ratio over binned counts of its text (those of the quality rules),
fitted on the labelled rows.  Levels above it: each path (host and language) has a quality that is drawn
around its host's, each host's around the corpus'.  Both are estimated from the documents' own posteriors:
sums by path and host are shrunk towards the level above, the more so the fewer documents there are, with the
strength of each prior taken from the data by the method of moments.  A document's prior leaves itself out.

Grouping is by sums only, partial before the shuffle; what is joined back is (path, two numbers).

Defined cases: a null text has no words; a null host or language is "(none)"; documents without label are
judged like all; labels without a document, null labels and repeated labels count by their rows; without any labels
the evidence is 0 and every document keeps the prior; rows that share an id are judged each by its text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import sized_broadcast
from .common import stash
from .quality_rules import text_counts

NONE = "(none)"


@dataclass(frozen=True)
class BayesParams:
    #: Labelled rows used, at most: chosen by hash of the id when there are more.
    max_labelled: int = 1_000_000
    #: Documents' evidence is shared out over correlated features: the ratio is taken to this power.
    temper: float = 0.6
    smoothing: float = 1.0
    prior_good: float = 0.85
    prior_strength: tuple[float, float] = (1.0, 500.0)
    keep_at: float = 0.5


DEFAULT = BayesParams()


def features() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """Value and bin edges of each feature."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "words": (F.col("n_words"), (5, 20, 50, 200, 1000, 5000)),
        "word_length": (F.col("word_chars") / n, (2, 3, 4, 5, 6, 7, 9, 12)),
        "symbols": (F.col("n_symbols") / n, (0.001, 0.01, 0.05, 0.1, 0.3, 1)),
        "repeats": (F.col("n_repeat_words") / n, (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)),
        "dup_lines": (F.col("n_dup_lines") / lines, (0.001, 0.05, 0.2, 0.5)),
        "capitals": (F.col("n_upper") / chars, (0.005, 0.02, 0.05, 0.1, 0.3, 0.6)),
        "shouting": (F.col("n_bang") / n, (0.001, 0.01, 0.1, 0.5)),
        "stops": (F.col("n_stops") / n, (0.002, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
        "variety": (F.col("n_distinct") / n, (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)),
    }


def _bins() -> dict[str, Column]:
    out = {}
    for name, (value, edges) in features().items():
        b = F.lit(len(edges))
        for i in reversed(range(len(edges))):
            b = F.when(value < edges[i], i).otherwise(b)
        out[f"b_{name}"] = b.cast("int")
    return out


def fit(rows: DataFrame, labels: DataFrame, p: BayesParams = DEFAULT) -> dict:
    """Log ratios by feature and bin, and the share of good rows.  ``rows`` has id and the bins; a few hundred sums are collected."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("lid"), "quality")
    share = min(1.0, p.max_labelled / max(known.count(), 1))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("lid"), F.lit(1_000_000)) < int(share * 1_000_000))
    names = list(features())
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"b_{n}").alias("bin")) for n in names])).alias("x")
    sums = rows.join(known, rows["id"] == known["lid"]).select("quality", pairs).groupBy("x.feature", "x.bin", "quality").agg(F.count("*").alias("n")).collect()
    size = {n: len(e) + 1 for n, (_, e) in features().items()}
    count = {(r["feature"], r["bin"], 1 if r["quality"] else 0): r["n"] for r in sums}
    total = [sum(v for (f, _, q), v in count.items() if f == names[0] and q == k) for k in (0, 1)]
    if not all(total):
        return {"good": p.prior_good, "ratios": {n: [0.0] * size[n] for n in names}}
    s = p.smoothing
    rate = lambda n, b, q: (count.get((n, b, q), 0) + s) / (total[q] + s * size[n])
    return {"good": total[1] / sum(total), "ratios": {n: [p.temper * math.log(rate(n, b, 1) / rate(n, b, 0)) for b in range(size[n])] for n in names}}


def _evidence(model: dict) -> Column:
    z = F.lit(0.0)
    for name, ratios in model["ratios"].items():
        z = z + F.element_at(F.array(*[F.lit(float(x)) for x in ratios]), F.col(f"b_{name}") + 1)
    return z


def _logit(c: Column) -> Column:
    return F.log(c) - F.log1p(-c)


def _sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def _strength(groups: DataFrame, within: str, p: BayesParams) -> float:
    """Prior strength k of a Beta(k m, k (1 - m)) over group means around ``within``, by moments."""
    r = groups.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(within), 2)).alias("between"), F.sum("n").alias("n"),
                                  F.sum(F.col("n") * F.col(within) * (1 - F.col(within))).alias("var"), F.count("*").alias("g")).first()
    if not r["n"] or r["g"] < 2:
        return p.prior_strength[1]
    mean_var = r["var"] / r["n"]
    spread = r["between"] / r["n"] - mean_var * r["g"] / r["n"]
    k = mean_var / spread - 1 if spread > 0 else p.prior_strength[1]
    return min(max(k, p.prior_strength[0]), p.prior_strength[1])


def classify(docs: DataFrame, labels: DataFrame, params: BayesParams = DEFAULT, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """id, key, evidence, document, host, path and joint posterior, kept, of every row of ``docs``."""
    d = docs.select("doc_id", "text", F.struct(F.coalesce(F.col(host_col), F.lit(NONE)).alias("host"), F.coalesce(F.col(path_col), F.lit(NONE)).alias("path")).alias("site"))
    # the counts' row keeps its site: an id of (doc_id, site)
    c = text_counts(d.select(F.struct("doc_id", "site").alias("id"), "text"), "id")
    c = c.select(F.col("id.doc_id").alias("id"), F.col("id.site.host").alias("host"), F.col("id.site.path").alias("path"), "key", *[x.alias(n) for n, x in _bins().items()])
    rows = stash(c, "bayes-bins")
    model = fit(rows, labels, params)
    prior = math.log(model["good"] / (1 - model["good"]))
    rows = rows.withColumn("evidence", _evidence(model)).withColumn("p", F.least(F.greatest(_sigmoid(F.col("evidence") + prior), F.lit(1e-6)), F.lit(1 - 1e-6)))
    paths = stash(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "bayes-paths")
    hosts = stash(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "bayes-hosts")
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else model["good"]
    kh = _strength(hosts.withColumn("m", F.lit(mean)), "m", params)
    hosts = hosts.select("host", ((F.col("s") + kh * mean) / (F.col("n") + kh)).alias("host_quality"))
    paths = stash(paths.join(hosts, "host"), "bayes-sites")
    kp = _strength(paths, "host_quality", params)
    sites = sized_broadcast(paths.select("host", "path", "host_quality", "s", "n"), 500_000)
    j = rows.select("id", "key", "host", "path", "evidence", "p").join(sites, ["host", "path"])
    j = j.withColumn("path_quality", (F.col("s") + kp * F.col("host_quality")) / (F.col("n") + kp))
    others = (F.col("s") - F.col("p") + kp * F.col("host_quality")) / (F.col("n") - 1 + kp)
    others = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    j = j.withColumn("posterior", _sigmoid(F.col("evidence") + _logit(others)))
    return j.select("id", "key", "host", "path", "evidence", F.col("p").alias("document_quality"), "host_quality", "path_quality", "posterior",
                    (F.col("posterior") >= params.keep_at).alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, params: BayesParams = DEFAULT) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return classify(docs, labels, params).select(F.col("id").alias("doc_id"), "host", "path", r("evidence"), r("document_quality"), r("host_quality"),
                                                 r("path_quality"), r("posterior"), "kept")

"""Quality rules as weak supervision.

Each rule looks at a few counts of a document and votes good (1), bad (-1) or abstains (0).  No rule is
trusted as such: expectation-maximisation over the table of vote patterns (at most 2^rules rows, whatever
the corpus) estimates the share of good documents and, for each rule, how often it votes on good and on
bad documents.  The posterior of a document's pattern replaces an all-rules-must-pass filter.

Everything is a built-in expression on the row that holds the text, so no text is shuffled; only vote
patterns are aggregated.

Defined cases: a null text has no words; a document without words gets no votes but fails the base rule;
rows that share an id are judged each by its own text; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_key, without, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RuleParams:
    min_words: int = 50
    max_repeat_pct: int = 50
    #: Keep at this posterior probability of being good, or more.
    min_posterior: float = 0.5
    #: Estimation ends here at the latest, with a warning that names the residual.
    max_iterations: int = 500
    tolerance: float = 1e-4
    #: Start of the estimates, also the mean of their prior.
    prior_good: float = 0.85
    #: How often a rule votes on documents of the kind it votes for, and on others.
    good_rate: tuple[float, float] = (0.6, 0.2)
    bad_rate: tuple[float, float] = (0.3, 0.01)
    min_odds: float = 1.5
    max_odds: float = 200.0
    #: Weight of that prior in documents.
    prior_weight: float = 20.0


DEFAULT = RuleParams()


def _covered(w: Column, n: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text.

    Windows are sorted by hash; a window with an equal neighbour is repeated, and the starts of the
    repeated windows, in order, give the union of their words.  No step is quadratic in the text."""
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                                       lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.coalesce(grams, F.array().cast("array<bigint>"))


def _union_of_windows(sorted_grams: Column) -> Column:
    def repeated(e, j):
        same = lambda k: F.coalesce(F.get(sorted_grams, k)["h"] == e["h"], F.lit(False))
        return same(j - 1) | same(j + 1)

    starts = F.sort_array(F.transform(F.filter(sorted_grams, repeated), lambda e: e["i"]))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                       lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")),
                       lambda acc: acc["n"])


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, the base counts and what else the rules look at; one row for each row of ``docs``."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("g", _covered(F.col("w"), F.col("n")))
    d = d.withColumn("n_lines", F.size("lines")).withColumn("n_grams", F.size("g"))
    d = d.withColumn("few", F.size(F.array_distinct("g")) == F.col("n_grams"))
    d = d.withColumn("s", F.when(~F.col("few"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    long = lambda c: c.cast("long")
    return d.select(
        "id", text_key(F.col("text")).alias("key"),
        long(F.col("n")).alias("n_words"),
        long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.col("n_lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.when(F.col("few"), 0).otherwise(_union_of_windows(F.col("s")))).alias("n_repeat_words"),
        long(F.col("n_lines")).alias("n_lines"),
        long(F.size(F.array_distinct("w"))).alias("n_distinct"),
        long(F.regexp_count("text", F.lit(r"\p{Lu}"))).alias("n_upper"),
        long(F.regexp_count("text", F.lit("!"))).alias("n_bang"),
        long(F.regexp_count("text", F.lit(r"[.?!:;\"'”»)](?=[\x20\x09-\x0D]|$)"))).alias("n_stops"),
    )


def base_failed(p: RuleParams = DEFAULT) -> Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_pct * F.col("n_words"))


def rules() -> dict[str, tuple[int, Column]]:
    """For each rule what it votes (1 good, -1 bad) and when; otherwise it abstains.

    Most rules know one defect and say nothing about a text without it."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    share = lambda c, of=n: F.col(c) / of
    some = F.col("n_words") >= 5
    out = {
        "word_length": (-1, ~share("word_chars").between(2.0, 15.0)),
        "symbols": (-1, share("n_symbols") > 0.3),
        "repeats": (-1, share("n_repeat_words") > 0.4),
        "dup_lines": (-1, share("n_dup_lines", lines) > 0.4),
        "capitals": (-1, share("n_upper", chars) > 0.4),
        "shouting": (-1, share("n_bang") > 0.3),
        "variety": (-1, (F.col("n_distinct") / n < 0.15) & F.col("n_words").between(50, 3000)),
        "prose": (1, share("n_stops").between(0.02, 0.4) & (share("n_symbols") < 0.1) & (share("n_upper", chars) < 0.15)),
        "fresh": (1, (F.col("n_distinct") / n > 0.4) & (share("n_repeat_words") < 0.1) & (share("n_symbols") < 0.1)),
    }
    return {k: (sign, some & when) for k, (sign, when) in out.items()}


def _votes() -> dict[str, Column]:
    return {f"v_{k}": F.when(when, sign).otherwise(0).cast("int") for k, (sign, when) in rules().items()}


def _posterior(est: dict) -> Column:
    """Posterior of the vote columns under the estimates, as a closed expression; who abstains says nothing."""
    z = F.lit(math.log(est["good"]) - math.log1p(-est["good"]))
    for r, (g, b) in est["rates"].items():
        z = z + F.when(F.col(f"v_{r}") != 0, math.log(g / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def estimate(patterns: DataFrame, p: RuleParams = DEFAULT) -> dict:
    """Expectation-maximisation over (v_<rule>..., n): the share of good documents, and how often each rule
    votes on good and on bad ones.  Each step is one aggregation of that small table to one row."""
    signs = {k: sign for k, (sign, _) in rules().items()}
    start = {k: (p.good_rate if s > 0 else p.bad_rate[::-1]) for k, s in signs.items()}
    est = {"good": p.prior_good, "rates": dict(start)}
    for _ in range(p.max_iterations):
        q, r = F.col("n") * F.col("q"), F.col("n") * (1 - F.col("q"))
        sums = [F.sum(q).alias("q"), F.sum(r).alias("r"), F.sum("n").alias("n")]
        for x in signs:
            sums += [F.sum(F.when(F.col(f"v_{x}") != 0, q)).alias(f"q_{x}"), F.sum(F.when(F.col(f"v_{x}") != 0, r)).alias(f"r_{x}")]
        row = patterns.withColumn("q", _posterior(est)).agg(*sums).first()
        if not row["n"]:
            break
        w, new = p.prior_weight, {}
        for x, s in signs.items():
            g = ((row[f"q_{x}"] or 0) + w * start[x][0]) / (row["q"] + w)
            b = ((row[f"r_{x}"] or 0) + w * start[x][1]) / (row["r"] + w)
            # a rule is never taken for its opposite, nor for more certain than max_odds
            new[x] = (g, min(max(b, g / p.max_odds), g / p.min_odds)) if s > 0 else (min(max(g, b / p.max_odds), b / p.min_odds), b)
        good = min(max((row["q"] + w * p.prior_good) / (row["n"] + w), 0.01), 0.99)
        moved = max([abs(good - est["good"])] + [abs(u - v) for x in signs for u, v in zip(new[x], est["rates"][x], strict=True)])
        est = {"good": good, "rates": new}
        if moved < p.tolerance:
            return est
    else:
        warnings.warn(f"estimates still move by {moved:.3g} after {p.max_iterations} iterations", stacklevel=2)
    return est


def judge(docs: DataFrame, params: RuleParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, counts, posterior, base_failed and kept of every row of ``docs``."""
    f = stash(text_counts(docs, id_col, text_col).withColumns(_votes()), "quality-votes")
    est = estimate(_patterns(f), params)
    f = f.withColumn("posterior", _posterior(est)).withColumn("base_failed", base_failed(params))
    return f.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= params.min_posterior))


def _patterns(f: DataFrame) -> DataFrame:
    """How many documents have each pattern of votes: at most 2^rules rows, whatever the corpus."""
    return stash(f.where(F.col("n_words") >= 5).groupBy(*_votes()).agg(F.count("*").alias("n")).coalesce(1), "quality-patterns")


def rule_report(docs: DataFrame, params: RuleParams = DEFAULT) -> dict:
    """The estimates alone: share of good documents and rates by rule."""
    return estimate(_patterns(text_counts(docs).withColumns(_votes())), params)


def filter_documents(docs: DataFrame, params: RuleParams = DEFAULT) -> DataFrame:
    """``docs`` without the rows that the rules reject; columns as they are."""
    return without(docs, judge(docs, params).where(~F.col("kept")).select("id", "key"))


def quality_verdicts(docs: DataFrame, params: RuleParams = DEFAULT) -> DataFrame:
    j = judge(docs, params)
    return j.select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept", F.round("posterior", 9).alias("posterior"))

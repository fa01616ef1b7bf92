"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic).  The cells' token weights are raked: scaled to the
target of each marginal in turn until all hold.  A cell's weight over its tokens is the expected number of
copies of its documents; each document gets the whole part of it for certain and one more with the rest as
probability, drawn from a hash of its id and text, so a rerun draws the same.

Only cells are shuffled and iterated over; each round is one join of the cells with each marginal's factors,
written to the shared folder.  The driver sees totals only.

Defined cases: nulls in source, language or topic form a value of their own, "(none)"; documents without
words have no tokens and are drawn with their cell; rows that share an id are drawn each by its text, equal
rows alike; an empty table gives an empty result; marginals that no weights can meet all at once end after
max_rounds, with the last marginal met.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.interim import passing
from ..operators.joins import sized_broadcast
from .common import fresh, stash, text_key, words

NONE = "(none)"


@dataclass(frozen=True)
class MixParams:
    #: Target share of a value: its share of tokens to this power, made to sum to 1.
    source_power: float = 0.5
    lang_power: float = 0.7
    topic_power: float = 0.7
    #: Tokens to draw, as a share of all.
    budget: float = 0.5
    tolerance: float = 1e-6
    #: Targets that contradict one another are never met; raking then ends here, with a warning that names the residual.
    max_rounds: int = 200
    seed: str = "mix"


DEFAULT = MixParams()
DIMS = ("source", "lang", "topic")


def topic(text: Column, n_tokens: Column) -> Column:
    """A topic from the text alone: tables, notices, code-like text, else prose by length."""
    return (F.when(F.regexp_count(text, F.lit(r" \| ")) > 5, "table")
            .when(F.lower(text).contains("licen"), "notice")
            .when(n_tokens < 150, "short").when(n_tokens < 600, "medium").otherwise("long"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], p: MixParams = DEFAULT) -> DataFrame:
    """``cells`` (dims, weight) with weights scaled until each marginal has its target (dim, target); targets share a total.

    A value without target, or whose weight is 0, gets none."""
    for dim, target in targets.items():  # the targets stay, so a round only joins the sums
        cells = cells.join(target.select(dim, F.col("target").alias(f"t_{dim}")), dim, "left")
    cells = stash(cells, "mix-cells")
    for _ in range(p.max_rounds):
        now, off = cells, []
        for dim in targets:
            now = now.where(F.col(f"t_{dim}").isNotNull())
            factor = now.groupBy(dim).agg(F.sum("weight").alias("sum"), F.first(f"t_{dim}").alias("target")).select(
                dim, F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias(f"f_{dim}"))
            now = now.join(factor, dim).withColumn("weight", F.col("weight") * F.col(f"f_{dim}"))
            off.append(f"f_{dim}")
        worst = F.greatest(*[F.max(F.abs(F.col(c) - 1)) for c in off])
        now = stash(now, "mix-cells")
        moved = now.agg(worst).first()[0] or 0.0
        cells = now.drop(*off)
        if moved < p.tolerance:
            break
    else:
        warnings.warn(f"raking ended after {p.max_rounds} rounds; a marginal is still off by a factor of {1 + moved:.6g}", stacklevel=2)
    return cells.drop(*[f"t_{dim}" for dim in targets])


def power_targets(cells: DataFrame, dim: str, power: float, total: float) -> DataFrame:
    """Target of each value of a marginal: its tokens to a power, scaled to ``total``."""
    t = stash(cells.groupBy(dim).agg(F.sum("weight").alias("w")).where("w > 0").select(dim, F.pow("w", F.lit(power)).alias("target")), "mix-target")
    whole = t.agg(F.sum("target")).first()[0] or 1.0
    return t.withColumn("target", F.col("target") * (total / whole))


def mix(docs: DataFrame, params: MixParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with added columns for source, lang, topic, tokens, probability (expected copies) and copies, and their names."""
    names = dict(zip((*DIMS, "tokens", "probability", "copies"), fresh(docs, *(f"mix_{c}" for c in (*DIMS, "tokens", "probability", "copies"))), strict=True))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn(names["tokens"], F.size(words(F.col(text_col))).cast("long"))
    d = d.withColumns({names["source"]: F.coalesce(F.col(source_col), F.lit(NONE)), names["lang"]: F.coalesce(F.col(lang_col), F.lit(NONE)),
                       names["topic"]: topic(text, F.col(names["tokens"]))})
    with passing() as keep:
        cells = stash(d.groupBy(*[F.col(names[x]).alias(x) for x in DIMS]).agg(F.sum(names["tokens"]).alias("n")).withColumn("weight", F.col("n").cast("double")), "mix-cells")
        total = (cells.agg(F.sum("weight")).first()[0] or 0.0) * params.budget
        powers = {"source": params.source_power, "lang": params.lang_power, "topic": params.topic_power}
        raked = rake(cells, {x: power_targets(cells, x, powers[x], total) for x in DIMS}, params)
        rate = raked.select(*[F.col(x).alias(f"r_{x}") for x in DIMS], F.when(F.col("n") > 0, F.col("weight") / F.col("n")).otherwise(params.budget).alias(names["probability"]))
        rate = keep(stash(rate, "mix-rates"))
    rate = sized_broadcast(rate, 200_000)
    on = [d[names[x]] == rate[f"r_{x}"] for x in DIMS]
    d = d.join(rate, on[0] & on[1] & on[2], "left").drop(*[f"r_{x}" for x in DIMS])
    # a cell whose values have no tokens at all isn't raked
    p = F.coalesce(F.col(names["probability"]), F.lit(params.budget))
    u = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(params.seed), F.col(id_col).cast("string"), text_key(F.col(text_col)).cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    d = d.withColumn(names["probability"], p)
    d = d.withColumn(names["copies"], (F.floor(names["probability"]) + F.when(u < F.col(names["probability"]) - F.floor(names["probability"]), 1).otherwise(0)).cast("long"))
    return d, names


def mixture(docs: DataFrame, params: MixParams = DEFAULT) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and copies of every document."""
    d, n = mix(docs, params)
    return d.select("doc_id", *[F.col(n[x]).alias(x) for x in DIMS], F.col(n["tokens"]).alias("n_tokens"),
                    F.round(n["probability"], 9).alias("probability"), F.col(n["copies"]).alias("copies"))


def sample(docs: DataFrame, params: MixParams = DEFAULT) -> DataFrame:
    """The documents drawn, with how often; all columns, and topic, n_tokens, copies under names that don't clash."""
    d, n = mix(docs, params)
    add = dict(zip(("topic", "n_tokens", "copies"), fresh(docs, "topic", "n_tokens", "copies"), strict=True))
    return d.where(F.col(n["copies"]) > 0).select(*[d[c] for c in docs.columns], F.col(n["topic"]).alias(add["topic"]),
                                                  F.col(n["tokens"]).alias(add["n_tokens"]), F.col(n["copies"]).alias(add["copies"]))

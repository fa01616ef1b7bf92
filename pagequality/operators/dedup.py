"""Near-duplicate removal that keeps the best copy.

Semantics: rows are visited by priority (score desc, then original order); a
row is dropped iff it shares an LSH bucket with a row already kept.  Texts
shorter than ``min_content_length`` are always kept and never indexed.

The sequential visit is replaced by rounds over buckets, never over pairs:

1. every bucket takes the minimum priority of its live members
   (a map-side-combined aggregate, so a bucket holding a third of all rows is
   reduced before the shuffle);
2. a live row that is that minimum in all of its buckets is kept -- every
   higher-priority neighbour is already decided and none of them was kept;
3. every other live member of a bucket holding a newly kept row is dropped;
4. repeat until no row is live.  State is checkpointed each round into the
   shared checkpoint folder, so lineage stays short and a lost executor only
   recomputes one round.

This equals the sequential greedy result, including chains (a~b~c with a
and c unlike keeps a and c).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..session import checkpoint_dir
from .minhash import lsh_bands, minhash_signature, shingle_text

ORD_BITS = 56


def priority(score_col: str | None, ord_col: str) -> F.Column:
    """Lower is better: (100 - score) in the high bits, ``ord`` below.
    A missing score counts as 50.  An ``ord`` outside [0, 2^56) is refused."""
    score = F.col(score_col) if score_col else F.lit(None)
    s = F.least(F.greatest(F.coalesce(score, F.lit(50)), F.lit(0)), F.lit(100)).cast("long")
    order = F.col(ord_col).cast("long")
    wrong = F.raise_error(F.concat(F.lit(f"{ord_col} must lie in [0, 2^{ORD_BITS}), not "), F.coalesce(order.cast("string"), F.lit("null"))))
    fits = (order >= 0) & (order < (1 << ORD_BITS))
    return (F.lit(100) - s) * F.lit(1 << ORD_BITS) + F.when(F.coalesce(fits, F.lit(False)), order).otherwise(wrong.cast("long"))


def exact_duplicates(df: DataFrame, ord_col: str, content_col: str, score_col: str | None = None) -> DataFrame:
    """Marks exact copies of the shingle text: ``exact_keep`` is true for the
    best-priority row of each identical text.  Group minima are computed with
    a combined aggregate, then joined back (AQE splits a hot text's rows)."""
    d = (df.withColumn("_pq_h", F.sha2(shingle_text(F.col(content_col)), 256))
         .withColumn("_pq_p", priority(score_col, ord_col)))
    best = d.groupBy("_pq_h").agg(F.min("_pq_p").alias("_pq_best"), F.count("*").alias("copies"))
    return (d.join(best, "_pq_h").withColumn("exact_keep", F.col("_pq_p") == F.col("_pq_best"))
            .withColumnRenamed("_pq_h", "text_hash").drop("_pq_p", "_pq_best"))


def bucket_members(df: DataFrame, ord_col: str, content_col: str, score_col: str | None,
                   params: Params = DEFAULT) -> DataFrame:
    """``(ord, prio, band, bvals)`` for every indexed row (length >= min)."""
    prio = priority(score_col, ord_col)
    indexed = df.where(F.coalesce(F.length(F.col(content_col)), F.lit(0)) >= params.min_content_length)
    sig = indexed.select(F.col(ord_col).alias("ord"), prio.alias("prio"),
                         minhash_signature(F.col(content_col), params).alias("sig"))
    return sig.select("ord", "prio", F.explode(lsh_bands(F.col("sig"), params)).alias("b")) \
        .select("ord", "prio", F.col("b.band").alias("band"), F.col("b.bvals").alias("bvals"))


def _persist_round(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def near_duplicate_status(members: DataFrame) -> DataFrame:
    """Resolve the greedy keep-best over bucket memberships.

    Returns ``(ord, kept boolean, dup_of bigint, round int)`` for every
    indexed row.  Rounds run until every row is decided.
    """
    members = _persist_round(members)
    status = members.select("ord", "prio").distinct().withColumn("kept", F.lit(None).cast("boolean")) \
        .withColumn("dup_of", F.lit(None).cast("long")).withColumn("round", F.lit(None).cast("int"))
    status = _persist_round(status)
    rnd = 0
    while True:
        live = status.where(F.col("kept").isNull()).select("ord")
        if live.limit(1).count() == 0:
            break
        rnd += 1
        lm = members.join(live, "ord", "left_semi")
        bmin = lm.groupBy("band", "bvals").agg(F.min("prio").alias("bmin"))
        tagged = lm.join(bmin, ["band", "bvals"])
        winners = (tagged.groupBy("ord").agg(F.min((F.col("prio") == F.col("bmin")).cast("int")).alias("ok"))
                   .where(F.col("ok") == 1).select("ord"))
        win_buckets = (tagged.join(winners, "ord", "left_semi")
                       .select("band", "bvals", F.col("ord").alias("winner"), F.col("prio").alias("wprio")))
        losers = (lm.join(win_buckets, ["band", "bvals"]).where(F.col("ord") != F.col("winner"))
                  .groupBy("ord").agg(F.min_by("winner", "wprio").alias("by")))
        upd = (winners.select("ord", F.lit(True).alias("k_new"), F.lit(None).cast("long").alias("by"))
               .unionByName(losers.select("ord", F.lit(False).alias("k_new"), "by")))
        status = (status.join(upd, "ord", "left")
                  .select("ord", "prio",
                          F.coalesce("kept", "k_new").alias("kept"),
                          F.when(F.col("kept").isNull() & (F.col("k_new") == F.lit(False)), F.col("by"))
                          .otherwise(F.col("dup_of")).alias("dup_of"),
                          F.when(F.col("kept").isNull() & F.col("k_new").isNotNull(), F.lit(rnd))
                          .otherwise(F.col("round")).alias("round")))
        status = _persist_round(status)
    return with_representative(members, status)


def with_representative(members: DataFrame, status: DataFrame) -> DataFrame:
    """``dup_of``: the kept row of the best priority that shares a bucket with a dropped one; null for kept rows.

    The rounds may have dropped it for a later one.  Bucket minima over kept rows and row minima over buckets, both
    combined before the shuffle; no pairs."""
    kept = members.join(status.where("kept").select("ord"), "ord", "left_semi")
    best = kept.groupBy("band", "bvals").agg(F.min("prio").alias("best"), F.min_by("ord", "prio").alias("best_ord"))
    dropped = members.join(status.where(~F.col("kept")).select("ord"), "ord", "left_semi")
    of = dropped.join(best, ["band", "bvals"]).groupBy("ord").agg(F.min_by("best_ord", "best").alias("dup_of"))
    return status.drop("dup_of").join(of, "ord", "left").select("ord", "kept", "dup_of", "round")


def dedup_status(df: DataFrame, ord_col: str, content_col: str, score_col: str | None = None,
                 params: Params = DEFAULT, scope_col: str | None = None) -> DataFrame:
    """``(ord_col, near_duplicate, dup_of)`` for every row of ``df``; with ``scope_col``, rows
    are compared with rows of the same scope only (``ord_col`` is unique over all).

    One pass over the input computes a narrow table -- priority, length,
    exact-text hash and (for indexed rows) the MinHash signature -- which is
    checkpointed; every later step reads only that table, so the input (and
    whatever scored it) is evaluated once and no text moves through the
    rounds.  Exact copies are resolved by a hash aggregate first; only the
    best copy of each distinct text enters the LSH rounds, since the other
    copies share all of its buckets and are dropped either way.
    """
    length = F.coalesce(F.length(F.col(content_col)), F.lit(0))
    indexed = length >= params.min_content_length
    scope = F.concat(F.coalesce(F.col(scope_col).cast("string"), F.lit("")), F.lit("\n")) if scope_col else F.lit("")
    narrow = df.select(
        F.col(ord_col).cast("long").alias("ord"), priority(score_col, ord_col).alias("prio"),
        indexed.alias("indexed"),
        F.when(indexed, F.sha2(F.concat(scope, shingle_text(F.col(content_col))), 256)).alias("text_hash"), scope.alias("scope"),
        F.when(indexed, minhash_signature(F.col(content_col), params)).alias("sig"))
    narrow = _persist_round(narrow)
    idx = narrow.where(F.col("indexed"))
    best = idx.groupBy("text_hash").agg(F.min("prio").alias("best_prio"))
    idx = idx.join(best, "text_hash").withColumn("exact_keep", F.col("prio") == F.col("best_prio"))
    reps = idx.where(F.col("exact_keep"))
    members = reps.select("ord", "prio", "scope", F.explode(lsh_bands(F.col("sig"), params)).alias("b")) \
        .select("ord", "prio", F.struct("scope", "b.band").alias("band"), F.col("b.bvals").alias("bvals"))
    # a bucket with one member decides nothing; rows that share none are kept without a round
    shared = members.groupBy("band", "bvals").agg(F.count("*").alias("n")).where("n > 1").select("band", "bvals")
    members = members.join(shared, ["band", "bvals"], "left_semi")
    status = near_duplicate_status(members)
    rep_status = (reps.join(status, "ord", "left")
                  .select("text_hash", F.col("ord").alias("rep"),
                          (~F.coalesce(F.col("kept"), F.lit(True))).alias("rep_dropped"),
                          F.col("dup_of").alias("rep_dup_of")))
    out_idx = idx.join(rep_status, "text_hash", "left")
    is_rep = F.col("ord") == F.col("rep")
    out_idx = out_idx.select(
        "ord",
        F.when(is_rep, F.col("rep_dropped")).otherwise(F.lit(True)).alias("near_duplicate"),
        F.when(is_rep, F.col("rep_dup_of")).otherwise(F.coalesce(F.col("rep_dup_of"), F.col("rep"))).alias("dup_of"))
    short = narrow.where(~F.col("indexed")).select(
        "ord", F.lit(False).alias("near_duplicate"), F.lit(None).cast("long").alias("dup_of"))
    return short.unionByName(out_idx).withColumnRenamed("ord", ord_col)


def deduplicate(df: DataFrame, ord_col: str, content_col: str, score_col: str | None = None,
                params: Params = DEFAULT, with_dropped: bool = False) -> DataFrame:
    """Rows of ``df`` that survive near-duplicate removal (all rows with
    ``near_duplicate`` and ``dup_of`` when ``with_dropped``)."""
    st = dedup_status(df, ord_col, content_col, score_col, params)
    out = df.join(st.withColumn(ord_col, F.col(ord_col).cast(df.schema[ord_col].dataType)), ord_col)
    return out if with_dropped else out.where(~F.col("near_duplicate")).drop("near_duplicate", "dup_of")

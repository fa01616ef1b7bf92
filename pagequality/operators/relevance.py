"""Relevance providers.

* ``cosine_relevance``: vectors are input columns (any embedding job can fill
  them); the score is the clamped cosine, 0 when a vector is missing.
* ``lexical_relevance``: TF-IDF cosine computed as Spark joins and
  aggregates over exploded terms -- term frequencies per text, counted where the
  text lies, document frequencies per term (combined aggregates, so a stop word
  present in every text is pre-aggregated before its shuffle), and a dot product per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .interim import written
from .joins import sized_broadcast
from .text_stats import token_array


def cosine(a: Column, b: Column) -> Column:
    """Clamped cosine of two vectors, in double; 0 when either vector is missing or zero, has a null or NaN, or their lengths differ."""

    @F.arrow_udf("double")
    def cosines(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros(len(x))
        both = np.flatnonzero(pc.and_(x.is_valid(), y.is_valid()).to_numpy(zero_copy_only=False))
        sizes = [np.diff(v.offsets.to_numpy()) for v in (x, y)]
        both = both[sizes[0][both] == sizes[1][both]]
        for n in np.unique(sizes[0][both]):  # rows of one length at a time, all at once
            at = both[sizes[0][both] == n]
            u, v = (w.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n) for w in (x, y))
            length = np.sqrt((u * u).sum(1) * (v * v).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[at] = np.nan_to_num(np.clip((u * v).sum(1) / length, 0.0, 1.0), nan=0.0)
        return pa.array(out)

    return cosines(a, b)


def cosine_relevance(df: DataFrame, vec_col: str, queries: DataFrame, query_key: str,
                     query_vec_col: str = "query_vec", out: str = "relevance") -> DataFrame:
    """Each row against its own query's vector (equi-join on ``query_key``;
    the query side is broadcast only after its size is checked)."""
    q = queries.select(query_key, F.col(query_vec_col).alias("_pq_qv"))
    d = df.join(sized_broadcast(q, 1_000_000), query_key, "left")
    return d.withColumn(out, cosine(F.col("_pq_qv"), F.col(vec_col))).drop("_pq_qv")


def label_query_vectors(emb: DataFrame, key: str = "vec_id", label: str = "label",
                        vec: str = "embedding") -> DataFrame:
    """A query vector per label: the vector of the label's lowest id."""
    first = sized_broadcast(emb.groupBy(label).agg(F.min(key).alias("query_id")).withColumnRenamed(label, "_pq_l"), 100_000)
    found = emb.join(first, (F.col(label) == F.col("_pq_l")) & (F.col(key) == F.col("query_id")))
    return found.select(label, F.col(vec).alias("query_vec"), "query_id").dropDuplicates([label])


def _parts(df: DataFrame) -> int:
    """A stated number of tasks, as many as a shuffle has: texts are small beside the terms in them, and would be dealt to few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def term_counts(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, term, tf)`` of lower-cased terms; texts of one key count as one text.

    The texts are dealt out by key, a row each, so that their terms are counted where they lie."""
    t = texts.select(F.col(key).alias("_pq_k"), F.col(text_col).alias("_pq_t")).repartition(_parts(texts), "_pq_k")
    terms = t.select("_pq_k", F.explode(token_array(F.lower("_pq_t"))).alias("term"))
    return terms.groupBy("_pq_k", "term").agg(F.count("*").alias("tf")).select(F.col("_pq_k").alias(key), "term", "tf")


def inverse_frequencies(tf: DataFrame, n_texts: int) -> DataFrame:
    """``(term, idf)`` with idf = ln((N+1)/(df+1)) + 1, written; broadcast where it is small."""
    dfreq = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = dfreq.select("term", (F.log(F.lit(float(n_texts + 1)) / (F.col("df") + 1)) + 1).alias("idf"))
    return sized_broadcast(written(idf, "idf"), 1_000_000)


def shared_terms(pairs: DataFrame, texts: DataFrame, key: str, text_col: str, left: str, right: str) -> DataFrame:
    """``(left, right, term, product)`` for the terms that both texts of a pair have: the product of their counts, times the pair's rows.

    The texts go to their pairs whole, a row each, and are taken apart there; so only terms that are shared leave a task."""
    t = texts.select(F.col(key).alias("_pq_k"), F.col(text_col).alias("_pq_t")).repartition(_parts(texts), "_pq_k")
    p = pairs.groupBy(F.col(left).alias("_pq_l"), F.col(right).alias("_pq_r")).agg(F.count("*").alias("_pq_m"))
    sides = [p.join(t, F.col(side) == F.col("_pq_k")).select("_pq_l", "_pq_r", "_pq_m", F.lit(side == "_pq_l").alias("_pq_q"), "_pq_t")
             for side in ("_pq_l", "_pq_r")]
    both = sides[0].unionByName(sides[1]).repartition(_parts(texts), "_pq_l", "_pq_r")
    terms = both.select("_pq_l", "_pq_r", "_pq_m", "_pq_q", F.explode(token_array(F.lower("_pq_t"))).alias("term"))
    n = terms.groupBy("_pq_l", "_pq_r", "_pq_m", "term").agg(F.count_if("_pq_q").alias("a"), F.count_if(~F.col("_pq_q")).alias("b"))
    return n.where("a > 0 AND b > 0").select(F.col("_pq_l").alias(left), F.col("_pq_r").alias(right), "term",
                                            (F.col("a") * F.col("b") * F.col("_pq_m")).alias("product"))


def lexical_relevance(pairs: DataFrame, texts: DataFrame, key: str, text_col: str,
                      left: str = "query_key", right: str = "text_key") -> DataFrame:
    """TF-IDF cosine for ``pairs(left, right)`` of text ids in ``texts``.

    Texts are moved, not terms: a term's weight is looked up where its text was counted."""
    tf = written(term_counts(texts, key, text_col), "terms")
    n_texts = texts.select(key).distinct().count()  # one scalar to the driver
    idf = inverse_frequencies(tf, n_texts)
    w = F.col("tf") * F.col("idf")
    norms = written(tf.join(idf, "term").groupBy(key).agg(F.sqrt(F.sum(w * w)).alias("norm")), "norms")
    dots = (shared_terms(pairs, texts, key, text_col, left, right).join(idf, "term")
            .groupBy(left, right).agg(F.sum(F.col("product") * F.col("idf") * F.col("idf")).alias("dot")))
    nl = norms.select(F.col(key).alias(left), F.col("norm").alias("nl"))
    nr = norms.select(F.col(key).alias(right), F.col("norm").alias("nr"))
    out = (pairs.join(dots, [left, right], "left").join(nl, left, "left").join(nr, right, "left"))
    rel = F.when((F.col("nl") > 0) & (F.col("nr") > 0),
                 F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("dot", F.lit(0.0)) / (F.col("nl") * F.col("nr"))))
                 ).otherwise(F.lit(0.0))
    return out.withColumn("relevance", rel).drop("dot", "nl", "nr")

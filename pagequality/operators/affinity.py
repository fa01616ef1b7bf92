"""Sample affinity: an ``ai_score`` provider built as a Spark join.

How much of a text is already covered by a sample corpus: the share of the
text's word trigrams that also occur in the sample.  Above a threshold the
text gets ``ai_score`` 1.0, else 0.0 (the score's input contract).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .joins import sized_broadcast
from .text_stats import token_array


def word_trigrams(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, gram)`` for every word trigram of the lower-cased text."""
    words = df.select(F.col(key).alias("_k"), token_array(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("w"))
    w = F.col("w")  # a column of its own: each use of the expression would split the text anew
    n = F.size(w)
    z = F.arrays_zip(w, F.slice(w, 2, F.greatest(n - 1, F.lit(0))), F.slice(w, 3, F.greatest(n - 2, F.lit(0))))
    d = words.select("_k", F.explode(z).alias("z"))
    f = d.schema["z"].dataType.fieldNames()
    d = d.where(F.col("z")[f[2]].isNotNull())
    return d.select(F.col("_k").alias(key),
                    F.concat_ws(" ", F.col("z")[f[0]], F.col("z")[f[1]], F.col("z")[f[2]]).alias("gram"))


def sample_affinity(texts: DataFrame, key: str, text_col: str, sample: DataFrame, sample_text_col: str = "text",
                    params: Params = DEFAULT) -> DataFrame:
    """``(key, grams, covered, affinity, ai_score)`` for every text."""
    sample_grams = word_trigrams(sample.withColumn("_sid", F.monotonically_increasing_id()), "_sid",
                                 sample_text_col).select("gram").distinct().withColumn("_hit", F.lit(1))
    grams = word_trigrams(texts, key, text_col)
    hits = grams.join(sized_broadcast(sample_grams, 5_000_000), "gram", "left")
    per = hits.groupBy(key).agg(F.count("*").cast("long").alias("grams"),
                                F.count("_hit").cast("long").alias("covered"))
    out = texts.select(key).join(per, key, "left").fillna(0, ["grams", "covered"])
    aff = F.when(F.col("grams") > 0, F.col("covered") / F.col("grams")).otherwise(F.lit(0.0))
    return out.withColumn("affinity", aff).withColumn(
        "ai_score", F.when(F.col("affinity") > params.affinity_threshold, F.lit(1.0)).otherwise(F.lit(0.0)))

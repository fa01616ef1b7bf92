"""Helpers shared by the corpus operators: table access, written intermediates, collision-free names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.interim import written
from ..operators.joins import sized_broadcast

#: ASCII white space; words are maximal runs of anything else.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back; the folder goes when the application ends.

    Cuts the lineage: a lost executor costs the tasks it ran, not the jobs before them."""
    return written(df, name, **options)


def words(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id; null and empty texts differ from all others."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def without(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, text) isn't in ``drop`` (columns ``id``, ``key``); all columns are left as they are.

    ``drop`` is read twice.  While it is small it goes to the texts, beyond that the texts are shuffled once."""
    k, i, h = fresh(docs, "__key", "__id", "__hash")
    right = sized_broadcast(drop.select(F.col("id").alias(i), F.col("key").alias(h)), 1_000_000)
    left = docs.withColumn(k, text_key(docs[text_col]))
    return left.join(right, left[id_col].eqNullSafe(right[i]) & (left[k] == right[h]), "left_anti").drop(k)

"""Search rows against fetched pages by position, and the stop after a refused batch.

Pages come back as a list in the order of the result list, in batches; when every fetch of a batch is refused, the
run stops, so its pages are a prefix and the tail of its results has no page.  Both sides are numbered by
:func:`with_rank` and joined on (group, position); counts come from aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import sized_broadcast
from .ranking import with_rank

#: Sizes of the batches of a run, in turn.
BATCHES = (2, 3, 4)


def refused(success: Column, message: Column, is_exception: Column) -> Column:
    """A fetch that came back with a refusal; an exception is an error, whatever it says."""
    return ~F.coalesce(is_exception, F.lit(False)) & ~F.coalesce(success, F.lit(False)) & F.coalesce(message.contains("403"), F.lit(False))


def batch_of(position: Column, sizes=BATCHES) -> Column:
    """Number, from 0, of the batch that position 1, 2, ... falls in."""
    at = (position - 1) % sum(sizes)
    inside = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 2, -1, -1):
        inside = F.when(at < sum(sizes[: k + 1]), F.lit(k)).otherwise(inside)
    return F.floor((position - 1) / sum(sizes)).cast("long") * len(sizes) + inside


def until_refused(fetches: DataFrame, group_cols, position_col: str = "position", refused_col: str = "refused",
                  sizes=BATCHES) -> DataFrame:
    """The fetches that a run makes: all up to and with the first batch of which every fetch was refused."""
    groups = list(group_cols)
    d = fetches.withColumn("_pq_batch", batch_of(F.col(position_col), sizes))
    batches = d.groupBy(*groups, "_pq_batch").agg(F.bool_and(refused_col).alias("_pq_all"))
    stops = batches.where("_pq_all").groupBy(*groups).agg(F.min("_pq_batch").alias("_pq_stop"))
    stops = sized_broadcast(stops.select(*[F.col(g).alias(f"_pq_g{i}") for i, g in enumerate(groups)], "_pq_stop"), 1_000_000)
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_pq_g{i}"))
    d = d.join(stops, same, "left")
    return d.where(F.col("_pq_stop").isNull() | (F.col("_pq_batch") <= F.col("_pq_stop"))).select(*fetches.columns)


def zip_rows(left: DataFrame, right: DataFrame, group_cols, left_order: list[Column], right_order: list[Column],
             out: str = "position") -> DataFrame:
    """Rows of both sides that have the same position in their group, as columns of ``left``, ``out`` and the other
    columns of ``right``; the longer side's tail is left out.  A null group is a group."""
    groups = list(group_cols)
    a = with_rank(left, groups, left_order, out)
    b = with_rank(right, groups, right_order, "_pq_position").select(
        *[F.col(g).alias(f"_pq_g{i}") for i, g in enumerate(groups)], "_pq_position", *[c for c in right.columns if c not in groups])
    same = F.col(out) == F.col("_pq_position")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_pq_g{i}"))
    return a.join(b, same).drop("_pq_position", *[f"_pq_g{i}" for i in range(len(groups))])


def zip_counts(left: DataFrame, right: DataFrame, group_cols) -> DataFrame:
    """Per group: results, matched, and dropped_tail, the results without a page."""
    groups = list(group_cols)
    sides = left.select(*groups, F.lit(1).alias("_pq_l"), F.lit(0).alias("_pq_r")).unionByName(
        right.select(*groups, F.lit(0).alias("_pq_l"), F.lit(1).alias("_pq_r")))
    n = sides.groupBy(*groups).agg(F.sum("_pq_l").alias("results"), F.sum("_pq_r").alias("_pq_pages"))
    matched = F.least("results", "_pq_pages")
    return n.select(*groups, F.col("results").cast("long").alias("results"), matched.cast("long").alias("matched"),
                    (F.col("results") - matched).cast("long").alias("dropped_tail"))

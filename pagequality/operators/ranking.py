"""Ranks inside groups of any size, by any sort keys.

A window over a group sorts the whole group in one task.  Here the rows are sorted over all tasks (ranges of
group and sort keys, from a sample), written with the number that each row has in its task, and the counts of each (task,
group) piece give the offset of that piece in its group.  So a group that holds a third of all rows is ranked by a third of
the tasks.  Only rows that are equal in the group and all sort keys stay in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .interim import written
from .joins import sized_broadcast


def _sorted_pieces(df: DataFrame, groups: list[str], order: list[Column], length: Column):
    """The sorted rows as a table with ``_pq_at`` and ``_pq_part``, and for each (group, task) piece what to add to the
    sums inside it: ``length`` of all pieces before."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(g).asc() for g in groups], *order]
    d = df.withColumn("_pq_len", length.cast("long")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    d = written(d.withColumn("_pq_at", F.monotonically_increasing_id()), "rank").withColumn("_pq_part", F.shiftrightunsigned("_pq_at", 33))
    pieces = d.groupBy(*groups, "_pq_part").agg(F.min("_pq_at").alias("_pq_first"), F.sum("_pq_len").alias("_pq_n"))
    before = Window.partitionBy(*groups).orderBy("_pq_part").rowsBetween(Window.unboundedPreceding, -1)  # a few rows a group
    shifts = pieces.select(*[F.col(g).alias(f"_pq_g{i}") for i, g in enumerate(groups)], F.col("_pq_part").alias("_pq_p"), "_pq_first",
                           F.coalesce(F.sum("_pq_n").over(before), F.lit(0)).alias("_pq_shift"))
    same = F.col("_pq_part") == F.col("_pq_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_pq_g{i}"))
    return d, sized_broadcast(shifts, 1_000_000), same


def with_rank(df: DataFrame, group_cols, order: list[Column], out: str = "rank") -> DataFrame:
    """Adds ``out``: 1, 2, ... by ``order`` inside each group, or over all rows without group columns.

    A null group is a group.  Rows that are equal in all sort keys get consecutive ranks in any order."""
    d, shifts, same = _sorted_pieces(df, list(group_cols), order, F.lit(1))
    rank = F.col("_pq_at") - F.col("_pq_first") + F.col("_pq_shift") + 1
    return d.join(shifts, same).withColumn(out, rank).select(*df.columns, out)


def with_offset(df: DataFrame, group_cols, order: list[Column], length: Column, out: str = "offset") -> DataFrame:
    """Adds ``out``: the sum of ``length`` (null: 0) over the rows before, by ``order`` inside each group.  A window runs over the
    rows that one sorted task had of a group only."""
    d, shifts, same = _sorted_pieces(df, list(group_cols), order, F.coalesce(length, F.lit(0)))
    inside = Window.partitionBy(*list(group_cols), "_pq_part").orderBy("_pq_at").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_pq_sum", F.coalesce(F.sum("_pq_len").over(inside), F.lit(0)))
    return d.join(shifts, same).withColumn(out, F.col("_pq_sum") + F.col("_pq_shift")).select(*df.columns, out)

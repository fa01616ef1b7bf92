"""Row positions inside a group without a window over the whole group.

A window ``partitionBy(group).orderBy(ord)`` sorts a whole group in one task;
a session or query holding a third of all rows would then sit on one core.
Here the integer order key is cut into blocks of ``block`` consecutive values:
block sizes are counted with a combined aggregate, turned into offsets by a
window over the (few) blocks of each group, and ``row_number`` runs only
inside one block, which holds at most ``block`` rows when ``ord`` is unique
within the group.  A null group is a group; rows without ``ord`` come last in
theirs, in any order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, group_cols, ord_col: str, out: str = "position",
                  block: int = 4096) -> DataFrame:
    """Adds ``out`` = 1-based position of the row inside its group by ``ord``."""
    groups = list(group_cols)
    d = df.withColumn("_pq_blk", F.floor(F.col(ord_col) / F.lit(block)))
    counts = d.groupBy(*groups, "_pq_blk").agg(F.count("*").alias("_pq_n"))
    w = Window.partitionBy(*groups).orderBy(F.asc_nulls_last("_pq_blk"))
    offsets = counts.withColumn(
        "_pq_off", F.coalesce(F.sum("_pq_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = [*groups, "_pq_blk"]
    offsets = offsets.select("_pq_off", *[F.col(c).alias(f"_pq_k{i}") for i, c in enumerate(keys)])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_pq_k{i}")) for i, c in enumerate(keys)])
    d = d.join(offsets, same).drop(*[f"_pq_k{i}" for i in range(len(keys))])
    inner = Window.partitionBy(*groups, "_pq_blk").orderBy(ord_col)
    return d.withColumn(out, (F.col("_pq_off") + F.row_number().over(inner)).cast("long")).drop("_pq_blk", "_pq_off")

"""Join helpers: broadcast only behind a size check, shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bytes(field: T.StructField):
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(field.dataType, T.ArrayType):
        item = field.dataType.elementType
        size = F.octet_length(F.to_json(F.struct(c))) if isinstance(item, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)) else 8 * F.size(c)
    else:
        size = F.lit(0)
    return F.coalesce(size, F.lit(0)) + 16


def sized_broadcast(small: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint ``small`` for broadcast when it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    The measure runs on the small side only.  Beyond the bounds the frame is
    returned unhinted, so the planner (and AQE at runtime) picks a shuffle
    join instead of shipping an unbounded table to every executor.
    """
    width = sum((_bytes(f) for f in small.schema.fields), F.lit(0).cast("long"))
    n, size = small.limit(max_rows + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(small) if n <= max_rows and (size or 0) <= max_bytes else small

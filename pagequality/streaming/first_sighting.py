"""First sighting of each key on a stream, where an earlier row may come late.

Each key holds its earliest row so far, in explicit state.  A row that comes later but happened earlier takes its place,
as long as the watermark hasn't passed it.  A timer on the event time gives the row out once nothing earlier can come any more;
from then on the key is only remembered, for ``remember_ms`` of event time, so that later copies give no second row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def earliest_stream(stream: DataFrame, key_cols: list[str], event_time: str, tie_col: str, delay_ms: int = 3_600_000,
                    remember_ms: int = 10 * 365 * 86_400_000) -> DataFrame:
    """``key_cols``, ``event_time`` and ``tie_col`` of each key's earliest row, by (event time, tie); both must be there.

    Equals the batch result for keys of which no row comes more than ``delay_ms`` late.  Rows without an event time are left out."""
    s = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).where(F.col(event_time).isNotNull())
    s = s.select(*key_cols, event_time, F.col(tie_col).cast("long").alias(tie_col))
    s = s.withColumn("_pq_us", F.unix_micros(event_time)).withWatermark(event_time, f"{delay_ms} milliseconds")
    kinds = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    out = ", ".join(f"{c} {kinds[c]}" for c in key_cols) + f", us long, {tie_col} long"

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            us, tie, given = state.get
            if given:
                state.remove()
                return
            state.update((us, tie, True))
            state.setTimeoutTimestamp(max(us // 1000 + remember_ms, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame([[*key, us, tie]], columns=[*key_cols, "us", tie_col])
            return
        us, tie, given = state.get if state.exists else (None, None, False)
        for b in batches:
            if given or b.empty:
                continue
            first = b.sort_values(["_pq_us", tie_col]).iloc[0]
            row = (int(first["_pq_us"]), int(first[tie_col]))
            us, tie = row if us is None else min(row, (us, tie))
        if not given and us is not None:
            state.update((us, tie, False))
            state.setTimeoutTimestamp(max(us // 1000 + delay_ms, state.getCurrentWatermarkMs() + 1))

    held = s.groupBy(*key_cols).applyInPandasWithState(hold, out, "us long, tie long, given boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return held.select(*key_cols, F.timestamp_micros("us").alias(event_time), tie_col)

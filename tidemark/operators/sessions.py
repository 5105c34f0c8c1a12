"""Activity split into sessions by gaps of inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.runs import coalesce_runs


def sessionize(events: DataFrame, key: str, time_ms: str, gap_ms: int) -> DataFrame:
    """Sessions of each ``key``: key, start_ms, end_ms, duration_ms, event_count.

    An event more than ``gap_ms`` after the key's previous event opens a new session (exactly ``gap_ms`` does not). Secondary sort
    by key and time, then one linear scan of each partition with constant memory; a hot key is spread over many partitions
    (see ``runs``). Events with a null key or time are left out; equal events count each; an empty table gives no sessions.
    Columns of ``events`` other than these two are not read.
    """
    time = F.col(f"`{time_ms}`").cast("bigint")
    runs = coalesce_runs(events.select(F.col(f"`{key}`").alias("key"), time.alias("lo"), time.alias("hi"), F.lit(1).cast("bigint").alias("n")), gap_ms)
    return runs.select(F.col("key").alias(key), F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"), (F.col("hi") - F.col("lo")).alias("duration_ms"), F.col("n").alias("event_count"))

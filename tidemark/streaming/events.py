"""Event streams: duplicates dropped, windows and sessions counted, late events bounded by a watermark.

The batch operators need no stream; these are the same results kept up to date as files or messages arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, directory: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, n of tumbling windows; events later than ``late`` are dropped."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark; the state of older keys is given up."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, time: str, key: str, gap: str = "120 minutes", late: str = "4 hours") -> DataFrame:
    """Sessions of each key: key, session_start, session_end (last event plus the gap), n."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What is there is processed and appended as Parquet, exactly once with this checkpoint; the query then ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

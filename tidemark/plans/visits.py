"""The visits table as the queries need it: feeds joined, instants resolved, rows of a visit merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import with_instant
from tidemark.session import load


def visit_key(visit_id: str = "visit_id") -> Column:
    """Letters and digits of a visit id in upper case; null where it has none."""
    return F.nullif(F.upper(F.regexp_replace(F.col(visit_id), r"[^\p{L}\p{N}]", "")), F.lit(""))


def with_feed(spark: SparkSession, sf_dir: str, visits: DataFrame) -> DataFrame:
    """Visits with zone and date order of their feed (null where the feed is unknown). Spark broadcasts feeds while small."""
    feeds = load(spark, sf_dir, "feeds").select("feed_id", "tz_name", "date_order").dropDuplicates(["feed_id"])
    return visits.join(feeds, "feed_id", "left")


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-null time of visits: row_id, field, text, tz_name, date_order."""
    visits = load(spark, sf_dir, "visits").select("row_id", "visit_start_time", "visit_end_time", "feed_id")
    both = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("visit_start_time", "visit_end_time")])
    return with_feed(spark, sf_dir, visits).select("row_id", "tz_name", "date_order", F.inline(both)).where(F.col("text").isNotNull())


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, field, utc_ms of every time that names an instant."""
    return with_instant(time_texts(spark, sf_dir), "text", "tz_name", "date_order", "utc_ms").where(F.col("utc_ms").isNotNull()).select("row_id", "field", "utc_ms")


def merged_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit: nurse_id, start_ms, end_ms as any of its rows has them.

    The rows' partial maxima are combined before the shuffle, so a visit with many copies costs no more than one.
    A row whose visit id holds no letter or digit is a visit of its own.
    """
    visits = load(spark, sf_dir, "visits").select("row_id", "visit_id", "nurse_id", "visit_start_time", "visit_end_time", "feed_id")
    rows = with_instant(with_feed(spark, sf_dir, visits), "visit_start_time", "tz_name", "date_order", "start_ms")
    rows = with_instant(rows, "visit_end_time", "tz_name", "date_order", "end_ms")
    key = F.coalesce(visit_key(), F.concat(F.lit("row "), F.col("row_id").cast("string")))
    return rows.groupBy(key.alias("visit")).agg(F.max("nurse_id").alias("nurse_id"), F.max("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))

"""Percentiles of very large numeric columns from counts in signed logarithmic buckets.

A bucket holds the values between two neighbouring powers of gamma = (1 + a) / (1 - a), apart for positive and negative values,
with one bucket for zero. Every value of a bucket is within the relative error a of the bucket's estimate. A sketch is a table of
bucket counts: it is counted by partial aggregation, and sketches of partitions, days or scrapes are combined by adding the counts
of equal buckets, which gives exactly the sketch of all values together. A group has as many rows as it has occupied buckets, whose
number is limited by the range of doubles, never by the number of values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_sketch(df: DataFrame, groups: Sequence[str], value: str, error: float = 0.01) -> DataFrame:
    """Sketch of ``value`` for each group: the group columns, sign (-1, 0, 1), bucket, n.

    Nulls, NaN and infinities are left out; null group keys form groups. An empty table gives an empty sketch.
    Columns of ``df`` other than those named are not read.
    """
    base = math.log((1 + error) / (1 - error))
    x = F.col(f"`{value}`").cast("double")
    rows = df.select(*[F.col(f"`{g}`") for g in groups], x.alias("_x")).where("_x is not null and not isnan(_x) and abs(_x) < double('infinity')")
    bucket = F.when(F.col("_x") != 0, F.ceil(F.log(F.abs("_x")) / base)).otherwise(0).cast("int")
    return rows.groupBy(*[F.col(f"`{g}`") for g in groups], F.signum("_x").cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One sketch for each of ``groups``: counts of equal buckets added, whatever other groups the parts had."""
    return sketch.groupBy(*[F.col(f"`{g}`") for g in groups], "sign", "bucket").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketch: DataFrame, groups: Sequence[str], shares: Sequence[float], error: float = 0.01) -> DataFrame:
    """Percentiles of each group: the group columns, n, and p<share * 100> for each share.

    Each is within the relative ``error`` of the value of rank floor(share * (n - 1)), counted from 0, among the group's
    values in order; the sketch must have been made with the same ``error``. Ties are no matter.
    """
    gamma = (1 + error) / (1 - error)
    keys = [F.col(f"`{g}`") for g in groups]
    place = F.col("sign") * F.col("bucket")
    order = Window.partitionBy(*keys).orderBy("sign", place)
    all_of = Window.partitionBy(*keys)
    estimate = F.col("sign") * F.pow(F.lit(gamma), F.col("bucket")) * (2 / (gamma + 1))
    cumulated = sketch.select(*keys, estimate.alias("_v"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"), F.sum("n").over(all_of).alias("_n"))
    name = lambda q: "p" + f"{q * 100:g}".replace(".", "_")
    picks = [F.min(F.when(F.col("_c") > F.floor(F.lit(float(q)) * (F.col("_n") - 1)), F.col("_v"))).alias(name(q)) for q in shares]
    return cumulated.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)

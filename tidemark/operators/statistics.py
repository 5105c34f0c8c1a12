"""Descriptive and inferential statistics as aggregations.

Quantiles are exact with linear interpolation, by counts in narrow buckets and a closer look at the few buckets that hold the
ranks sought; no task holds the values of a group. NaN counts as null. Rank tests count equal values first, so that ranks come from
a table of distinct values and never from a window over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.distributions import chi2_tail, t_tail
from tidemark.session import cut


def _number(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def adjusted_skew(column: Column) -> Column:
    """Bias-corrected skewness (G1); null below three values."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: dict[str, float], error: float = 0.001) -> DataFrame:
    """Exact quantiles with linear interpolation: the keys and one column for each named share.

    Values are counted in signed logarithmic buckets first; the counts say in which bucket each rank lies and how many values
    are below it. Only values of these buckets are then counted one by one. Groups with a null key and null or NaN values are
    left out; groups without values have no row (without keys: one row of nulls, if the table is empty).
    """
    base = math.log((1 + error) / (1 - error))
    x, far = F.col("_v"), 2_000_000
    infinite = F.abs(x) == float("inf")
    size = F.when(infinite, 2 * far).otherwise(F.ceil(F.log(F.abs(x)) / base) + far).cast("int")
    bucket = F.when(x > 0, size).when(x < 0, -size).otherwise(0)
    number = value.cast("double")
    kept = [F.col(f"`{k}`") for k in keys]
    rows = df.select(*kept, F.when(~F.isnan(number), number).alias("_v")).where("_v is not null").na.drop(subset=list(keys)) if keys else df.select(F.when(~F.isnan(number), number).alias("_v")).where("_v is not null")
    rows = rows.withColumn("_b", bucket)
    counts = rows.groupBy(*kept, "_b").agg(F.count(F.lit(1)).alias("_m"))
    up_to = Window.partitionBy(*kept).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_below", F.sum("_m").over(up_to) - F.col("_m")).withColumn("_n", F.sum("_m").over(Window.partitionBy(*kept)))
    at = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ranks = [F.struct(F.lit(f"{name} {side}").alias("_j"), rounding(at(q)).cast("bigint").alias("_rank")) for name, q in shares.items() for side, rounding in (("low", F.floor), ("high", F.ceil))]
    sought = placed.select(*kept, "_b", "_below", "_n", "_m", F.inline(F.array(*ranks))).where("_rank >= _below and _rank < _below + _m").drop("_m")
    on = [*keys, "_b"]
    near = rows.join(sought.select(*on).distinct(), on, "left_semi").groupBy(*kept, "_b", "_v").agg(F.count(F.lit(1)).alias("_m"))
    run = F.sum("_m").over(Window.partitionBy(*kept, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("_run", run).join(sought, on).where((F.col("_rank") < F.col("_below") + F.col("_run")) & (F.col("_rank") >= F.col("_below") + F.col("_run") - F.col("_m")))
    pick = lambda name, side: F.max(F.when(F.col("_j") == f"{name} {side}", F.col("_v")))
    out = found.groupBy(*kept).agg(F.max("_n").alias("_n"), *[pick(n, s).alias(f"_{n} {s}") for n in shares for s in ("low", "high")])
    low, high = (lambda n: F.col(f"`_{n} low`")), (lambda n: F.col(f"`_{n} high`"))
    part = lambda q: at(q) - F.floor(at(q))
    return out.select(*kept, *[F.when(low(n) == high(n), low(n)).otherwise(low(n) + (high(n) - low(n)) * part(q)).alias(n) for n, q in shares.items()])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, count, mean, std, min, p25, p50, p75, max, skew of each column, all columns by the same passes."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), _number(c).alias("_x")) for c in columns])))
    x = F.col("_x")
    rows = long.groupBy("column_name").agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), adjusted_skew(x).alias("skew"))
    q = exact_quantiles(long, ["column_name"], x, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(rows, "column_name", "left").join(q, "column_name", "left").select("column_name", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max", "skew")


def fences(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """One row: q1, q3 and the fences factor interquartile ranges beyond them."""
    q = exact_quantiles(df, [], _number(column), {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - factor * spread).alias("low"), (F.col("q3") + factor * spread).alias("high"))


def within_fences(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows whose value lies within the fences; nulls are left out."""
    limits = fences(df, column, factor).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    return df.crossJoin(F.broadcast(limits)).where(_number(column).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """bin (from 1), low, high, n of equal-width bins from the least to the greatest value, the last one closed."""
    x = _number(column)
    span = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    placed = df.where(x.isNotNull()).select(x.alias("_x")).crossJoin(F.broadcast(span))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_of = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width) + 1, F.lit(bins))).otherwise(1).cast("int")
    return placed.groupBy(bin_of.alias("bin"), (F.col("_lo") + (bin_of - 1) * width).alias("low"), (F.col("_lo") + bin_of * width).alias("high")).agg(F.count(F.lit(1)).alias("n"))


def boxplot(df: DataFrame, key: str, column: str, factor: float = 1.5) -> DataFrame:
    """key, q1, median, q3, whisker_low, whisker_high, fliers of each group; null keys are left out."""
    rows = df.where(F.col(key).isNotNull()).select(key, _number(column).alias("_x")).where("_x is not null")
    joined = rows.join(exact_quantiles(rows, [key], F.col("_x"), {"q1": 0.25, "median": 0.5, "q3": 0.75}), key)
    spread = F.col("q3") - F.col("q1")
    inside = F.col("_x").between(F.col("q1") - factor * spread, F.col("q3") + factor * spread)
    picks = [F.first(c).alias(c) for c in ("q1", "median", "q3")]
    return joined.groupBy(key).agg(*picks, F.min(F.when(inside, F.col("_x"))).alias("whisker_low"), F.max(F.when(inside, F.col("_x"))).alias("whisker_high"), F.count(F.when(~inside, True)).alias("fliers"))


def fliers(df: DataFrame, key: str, column: str, factor: float = 1.5) -> DataFrame:
    """The rows beyond the fences of their group; null keys and values are left out."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_x", _number(column)).where("_x is not null")
    joined = rows.join(exact_quantiles(rows.select(key, "_x"), [key], F.col("_x"), {"_q1": 0.25, "_q3": 0.75}), key)
    spread = F.col("_q3") - F.col("_q1")
    return joined.where(~F.col("_x").between(F.col("_q1") - factor * spread, F.col("_q3") + factor * spread)).drop("_x", "_q1", "_q3")


def percent_ranks(df: DataFrame, column: str, out: str = "percent_rank") -> DataFrame:
    """Each row with the share of the other rows below its value; null for null values and where there is one row."""
    x = _number(column)
    ranks = _value_ranks(df, x)
    total = ranks.agg(F.sum("_n").alias("_total"))
    placed = ranks.crossJoin(F.broadcast(total)).select("_v", F.try_divide(F.col("_rank") - (F.col("_n") - 1) / 2.0 - 1, F.col("_total") - 1).alias(out))
    return df.withColumn("_v", x).join(placed, "_v", "left").drop("_v")


def _value_ranks(df: DataFrame, value: Column) -> DataFrame:
    """Each distinct value with how many rows have it and their average rank.

    Distinct values are range-partitioned and numbered by the sum of the partitions before, so no task sees all of them.
    """
    counts = df.select(value.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.repartitionByRange("_v").withColumn("_part", F.spark_partition_id())
    placed = cut(placed)
    sums = placed.groupBy("_part").agg(F.sum("_n").alias("_s"))
    before = sums.select(F.col("_part"), (F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_before"))
    run = F.sum("_n").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_run", run).join(F.broadcast(before), "_part").select("_v", "_n", (F.col("_before") + F.col("_run") - (F.col("_n") - 1) / 2.0).alias("_rank"))


def kruskal(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row: h (corrected for ties), groups, n. Null keys and values are left out."""
    rows = df.where(F.col(key).isNotNull()).select(key, _number(column).alias("_v")).where("_v is not null")
    ranks = _value_ranks(rows, F.col("_v"))
    per_group = rows.groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_m")).join(ranks, "_v").groupBy(key).agg(F.sum(F.col("_m") * F.col("_rank")).alias("_r"), F.sum("_m").alias("_m"))
    total = per_group.agg(F.sum(F.col("_r") * F.col("_r") / F.col("_m")).alias("_s"), F.count(F.lit(1)).alias("groups"), F.sum("_m").alias("n"))
    ties = ranks.agg(F.sum(F.pow(F.col("_n").cast("double"), 3) - F.col("_n")).alias("_t"))
    n = F.col("n").cast("double")
    h = (F.lit(12.0) / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_t") / (n * n * n - n))
    return total.crossJoin(ties).select(h.alias("h"), "groups", "n")


def kruskal_test(df: DataFrame, key: str, column: str) -> tuple[float, float]:
    """H and its p-value."""
    row = kruskal(df, key, column).first()
    return row["h"], chi2_tail(row["h"], row["groups"] - 1)


def chi2_p(h: Column, degrees: Column) -> Column:
    """Upper tail of chi squared, for tables of a few test statistics."""
    return F.pandas_udf(lambda a, b: pd.Series([None if x is None or x != x else chi2_tail(float(x), int(v)) for x, v in zip(a, b, strict=True)], dtype="float64"), "double")(h, degrees)


def t_p(t: Column, degrees: Column) -> Column:
    """Upper tail of t, for tables of a few test statistics."""
    return F.pandas_udf(lambda a, b: pd.Series([None if x is None or x != x else t_tail(float(x), int(v)) for x, v in zip(a, b, strict=True)], dtype="float64"), "double")(t, degrees)


def kruskal_decided(df: DataFrame, key: str, column: str, level: float = 0.05) -> DataFrame:
    """One row: h, groups, n, p and whether the groups differ at the level."""
    tested = kruskal(df, key, column)
    return tested.withColumn("p", chi2_p(F.col("h"), F.col("groups") - 1)).withColumn("differs", F.col("p") < level)


#: The same in SQL as CTEs that end in ``tested``; the tail by Simpson's rule over 20,000 steps.
KRUSKAL_SQL = """r AS (SELECT {key} AS g, {value} AS v, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0::DOUBLE AS rk FROM {table} WHERE {key} IS NOT NULL AND {value} IS NOT NULL),
    gs AS (SELECT sum(rk) AS s, count(*) AS m FROM r GROUP BY g), ts AS (SELECT sum(pow(CAST(k AS DOUBLE), 3) - k) AS t FROM (SELECT count(*) AS k FROM r GROUP BY v)), sums AS (SELECT sum(s * s / m) AS s, count(*) AS groups, CAST(sum(m) AS BIGINT) AS n FROM gs),
    hs AS (SELECT (12.0::DOUBLE / (CAST(n AS DOUBLE) * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (pow(CAST(n AS DOUBLE), 3) - n)) AS h, groups, n, (groups - 1) / 2.0::DOUBLE AS a FROM sums, ts),
    tested AS (SELECT h, groups, n, 1 - h / 20000 / 3 * sum((CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * CASE WHEN i = 0 THEN (CASE WHEN a = 1 THEN 0.5 ELSE 0 END) ELSE exp((a - 1) * ln(h * i / 20000) - h * i / 40000 - a * ln(2) - lgamma(a)) END) AS p
        FROM hs, generate_series(0, 20000) s(i) GROUP BY h, groups, n, a)"""


def rank_auc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row: auc (ties count half), positives, negatives."""
    rows = df.select(label.cast("int").alias("_y"), score.cast("double").alias("_v")).where("_y is not null and _v is not null")
    ranks = _value_ranks(rows, F.col("_v"))
    totals = rows.groupBy("_v").agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_m")).join(ranks, "_v").agg(F.sum(F.col("_p") * F.col("_rank")).alias("_r"), F.sum("_p").alias("positives"), F.sum(F.col("_m") - F.col("_p")).alias("negatives"))
    p, q = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return totals.select(F.try_divide(F.col("_r") - p * (p + 1) / 2, p * q).alias("auc"), "positives", "negatives")


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """left, right, r of every pair of columns, by one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = df.agg(*[F.corr(_number(a), _number(b)).alias(f"_r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation."""
    return 2 * t_tail(abs(r) * ((n - 2) / max(1e-300, 1 - r * r)) ** 0.5, n - 2)


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, r2, n."""
    a, b = _number(x), _number(y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def trend_forecast(df: DataFrame, x: str, y: str, ahead: DataFrame, z: float = 1.96) -> DataFrame:
    """x, forecast, low, high at the points of ``ahead``: a linear trend with its prediction interval."""
    a, b = _number(x), _number(y)
    fit = df.agg(F.regr_slope(b, a).alias("_s"), F.regr_intercept(b, a).alias("_i"), F.regr_count(b, a).alias("_n"), F.regr_sxx(b, a).alias("_xx"), F.regr_syy(b, a).alias("_yy"), F.regr_sxy(b, a).alias("_xy"), F.regr_avgx(b, a).alias("_mx"))
    at = ahead.crossJoin(F.broadcast(fit))
    sigma = F.sqrt((F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx")) / (F.col("_n") - 2))
    spread = z * sigma * F.sqrt(1 + 1.0 / F.col("_n") + F.pow(F.col(x) - F.col("_mx"), F.lit(2)) / F.col("_xx"))
    forecast = F.col("_i") + F.col("_s") * F.col(x)
    return at.select(F.col(x), forecast.alias("forecast"), (forecast - spread).alias("low"), (forecast + spread).alias("high"))


def paired_t(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """One row: t of the paired differences left - right, and n."""
    d = (left - right).cast("double")
    return df.agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"), F.count(d).alias("n"))


def paired_t_test(df: DataFrame, left: Column, right: Column) -> tuple[float, float]:
    """t and the p-value of left being greater than right."""
    row = paired_t(df, left, right).first()
    return row["t"], t_tail(row["t"], row["n"] - 1)


def regression_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: rmse, mae, r2, n."""
    e = (truth - predicted).cast("double")
    both = F.when(e.isNotNull(), truth.cast("double"))
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(both) * F.count(both))).alias("r2"), F.count(e).alias("n"))


def classification_metrics(df: DataFrame, truth: Column, flagged: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, false_positive_rate."""
    count = lambda c: F.count(F.when(c, True))
    row = df.agg(count(truth & flagged).alias("tp"), count(~truth & flagged).alias("fp"), count(truth & ~flagged).alias("fn"), count(~truth & ~flagged).alias("tn"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return row.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), ratio("fp", "tn").alias("false_positive_rate"))


def two_level_mean(df: DataFrame, key: str, column: Column) -> DataFrame:
    """One row: the mean of the groups' means, which differs from the mean of all rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(column).alias("_m")).agg(F.avg("_m").alias("mean_of_means"), F.count("_m").alias("groups"))

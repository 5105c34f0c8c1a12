"""Cleaning, filling, aligning and picking rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.operators.statistics import exact_quantiles
from tidemark.session import cut


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order; null keys are equal to each other. Combined before the shuffle."""
    names = df.columns
    first = F.min_by(F.struct(*[_col(c) for c in names]), F.struct(*order))
    return df.groupBy(*[_col(k) for k in keys]).agg(first.alias("_first")).select(*[F.col(f"_first.`{c}`").alias(c) for c in names])


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, surplus copies and their percentage: one row."""
    per_key = df.groupBy(*[_col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))
    return total.select("row_count", "surplus", F.round(F.try_divide(F.col("surplus") * 100.0, F.col("row_count")), 6).alias("surplus_pct"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, nulls, non_nulls, null_pct of each column, by one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(_col(c)).alias(f"_c{k}") for k, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_c{k}").alias("non_nulls")) for k, c in enumerate(columns)])
    flat = counts.select("_n", F.inline(pairs))
    missing = F.col("_n") - F.col("non_nulls")
    return flat.select("column_name", missing.alias("nulls"), "non_nulls", F.round(F.try_divide(missing * 100.0, F.col("_n")), 6).alias("null_pct"))


def replace_exact(column: Column, mapping: Mapping[str, str]) -> Column:
    """Values of a dictionary replaced, all others kept."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, column), column)


def is_finite(column: Column) -> Column:
    """True for numbers; false for null, NaN and infinities."""
    x = column.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def mask_range(column: Column, low: float, high: float) -> Column:
    """The value where it lies in the closed range, else null."""
    return F.when(column.between(low, high), column)


def column_or(df: DataFrame, name: str, default: object) -> Column:
    """The column with nulls replaced, or the default where the table has no such column."""
    return F.coalesce(_col(name), F.lit(default)) if name in df.columns else F.lit(default)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def with_group_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Each row with the exact median of its group; rows with a null key get null. Spark broadcasts the medians while small."""
    return df.join(exact_quantiles(df, keys, _col(value), {out: 0.5}), list(keys), "left")


def fill_by_lookup(df: DataFrame, source: DataFrame, levels: Sequence[Sequence[str]], value: str, out: str) -> DataFrame:
    """A value looked up in ever wider groups of ``source``: the median of the first level that has one, at last of all rows."""
    candidates = []
    for depth, keys in enumerate(levels):
        df = df.join(exact_quantiles(source, keys, _col(value), {f"_level{depth}": 0.5}), list(keys), "left")
        candidates.append(F.col(f"_level{depth}"))
    df = df.crossJoin(F.broadcast(exact_quantiles(source, [], _col(value), {"_overall": 0.5}))).withColumn(out, F.coalesce(*candidates, F.col("_overall")))
    return df.drop(*[f"_level{d}" for d in range(len(levels))], "_overall")


def ordered_reindex(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of the listed keys with their position; listed keys without a row are left out, as are unlisted rows."""
    wanted = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(order)], f"`{key}` string, position int")
    return wanted.join(df, key)


def top_bottom(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n highest and the n lowest rows, with ``side`` ('top' or 'bottom') and ``place`` from 1."""
    sides = []
    for side, order in (("top", (F.desc(value), F.asc(tie))), ("bottom", (F.asc(value), F.asc(tie)))):
        kept = df.orderBy(*order).limit(n)
        sides.append(kept.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def best_of_group(df: DataFrame, keys: Sequence[str], value: str, prefer_low: str) -> DataFrame:
    """The row of each group with the highest value, ties going to the lowest ``prefer_low``."""
    best = F.max_by(F.struct(*[_col(c) for c in df.columns]), F.struct(_col(value), -_col(prefer_low)))
    return df.groupBy(*[_col(k) for k in keys]).agg(best.alias("_best")).select("_best.*")


def value_grid(low: Column, high: Column, step: float) -> Column:
    """Array of low, low + step, ... up to high, both ends included where the step meets them."""
    steps = F.floor((high - low) / step + 1e-9).cast("int")
    return F.when(steps >= 0, F.transform(F.sequence(F.lit(0), steps), lambda k: low + k * step))


def rank_with_ties(df: DataFrame, value: str, keep: int) -> DataFrame:
    """Rows of rank 1 to ``keep`` by value, all rows that tie with the last one included.

    The value at place ``keep`` is found first by a distributed top-k; ranks are then counted over distinct values, of which
    at most ``keep`` are left, so that no task sorts all rows however many tie.
    """
    bound = df.where(_col(value).isNotNull()).orderBy(F.desc(value)).limit(keep).agg(F.min(value).alias("_bound"))
    held = df.crossJoin(F.broadcast(bound)).where(_col(value) >= F.col("_bound")).drop("_bound")
    counts = held.groupBy(_col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_m"))
    ranks = counts.select("_value", (F.sum("_m").over(Window.orderBy(F.desc("_value"))) - F.col("_m") + 1).cast("int").alias("rank"))
    return held.join(F.broadcast(ranks), _col(value) == F.col("_value")).drop("_value")


def with_previous(df: DataFrame, key: str, time: str, tie: str, value: Column, out: str, width: str = "1 day") -> DataFrame:
    """Each row with ``value`` of the key's row before it, in order of time and tie; null for its first row.

    A row without time has no place in the order: it gets null and is before no other. Rows are ordered within stretches of time, so that a key with a third of all rows fills many tasks; the first row of a
    stretch takes the last value of the key's stretch before, from a table with one row for each key and stretch.
    """
    # By arithmetic, since F.window drops rows without time.
    micros = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {width}"))
    rows = df.withColumn("_stretch", F.floor(F.unix_micros(_col(time).cast("timestamp")) / micros)).withColumn("_value", F.struct(value.alias("v")))
    last = rows.where("_stretch is not null").groupBy(_col(key).alias("_key"), F.col("_stretch").alias("_s")).agg(F.max_by("_value", F.struct(_col(time), _col(tie))).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy("_key").orderBy("_s"))).drop("_last")
    here = F.lag("_value").over(Window.partitionBy(_col(key), "_stretch").orderBy(_col(time), _col(tie)))
    joined = rows.withColumn("_here", here).join(before, _col(key).eqNullSafe(F.col("_key")) & F.col("_stretch").eqNullSafe(F.col("_s")), "left")
    return joined.withColumn(out, F.when(F.col("_stretch").isNotNull(), F.coalesce("_here", "_before")["v"])).drop("_stretch", "_value", "_key", "_s", "_before", "_here")


def zscore(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Scores freed of their group's mean and sample deviation; null where a group does not vary."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    return df.join(stats, list(keys)).withColumn(out, F.when(F.col("_sd") > 0, (_col(value) - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def with_position(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """Each row with its place, from 1, in the order of the columns; rows that tie in all of them in any order.

    Rows are range-partitioned and numbered by the rows of the partitions before, so no task sees all of them.
    """
    keys = [_col(c) for c in order]
    placed = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return placed.withColumn("_here", here).join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(out, F.col("_before") + F.col("_here")).drop("_part", "_here", "_p", "_before")


#: Parts of the range of hashes that are counted to find the n-th one.
HASH_PARTS = 1 << 16


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all if there are fewer), the same ones on every run: those with the lowest seeded hash of their keys.

    Rows are counted by parts of the range of hashes; whole parts are taken or left, and only the part in which the n-th hash
    lies is sorted. One row of counts reaches the driver.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*[_col(k) for k in keys], F.lit(seed))).withColumn("_part", F.shiftright("_hash", 48))
    counts = hashed.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))  # at most HASH_PARTS rows
    upto = counts.withColumn("_below", F.sum("_m").over(Window.orderBy("_part")) - F.col("_m"))
    at = upto.where(F.col("_below") + F.col("_m") >= n).orderBy("_part").first() if n > 0 else None
    if at is None:
        return df if n > 0 else df.limit(0)
    last = hashed.where(F.col("_part") == at["_part"]).orderBy("_hash", *[_col(k) for k in keys]).limit(n - at["_below"])
    return hashed.where(F.col("_part") < at["_part"]).unionAll(last).drop("_hash", "_part")


def hash_split(df: DataFrame, keys: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """Rows marked ``is_train`` for about the given share, by a seeded hash of their keys."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(*[_col(k) for k in keys], F.lit(seed)), F.lit(10_000)) < int(share * 10_000))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, observed: their number can be read from the observation once an action has run, without another pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("row_count")), seen


def stacked(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of several tables, by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def excluded_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a row of equal keys in ``right``."""
    return left.join(right, list(keys), "left_anti")

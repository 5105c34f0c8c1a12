"""Preparation of features, models on a logarithmic target, expanding folds and stacking, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import is_finite, value_grid, with_position
from tidemark.operators.statistics import exact_quantiles, regression_metrics


def impute_and_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls replaced by the exact median, then centred and divided by the population deviation."""
    x = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    filled = df
    for c in columns:
        filled = filled.crossJoin(F.broadcast(exact_quantiles(df, [], x(c), {f"_med_{c}": 0.5})))
    filled = filled.withColumns({c: F.coalesce(x(c), F.col(f"_med_{c}")) for c in columns}).drop(*[f"_med_{c}" for c in columns])
    moments = filled.agg(*[F.avg(c).alias(f"_avg_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_avg_{c}")) / F.col(f"_sd_{c}")).otherwise(0.0) for c in columns}
    return filled.crossJoin(F.broadcast(moments)).withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in ("avg", "sd")])


def fill_with_mode(df: DataFrame, column: str) -> DataFrame:
    """Nulls replaced by the most frequent value, the smallest of those that tie."""
    mode = df.agg(F.mode(column, True).alias("_mode"))
    return df.crossJoin(F.broadcast(mode)).withColumn(column, F.coalesce(F.col(column), F.col("_mode"))).drop("_mode")


def one_hot_drop_first(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 column '<column>_<value>' for each value but the first in alphabetical order; null gives zeros.

    The result has a column for each value, so this is for columns of few values; ``one_hot_array`` takes any number.
    """
    values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values[1:]})


def one_hot_array(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: the place, from 0, of the row's value among all values in order, -1 for the first and null for none.

    As a sparse one-hot vector without its first entry has it; values are numbered by partitions, none reaches the driver.
    """
    numbered = with_position(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], "_place")
    return df.join(numbered.select(F.col(column), (F.col("_place") - 2).cast("int").alias(out)), column, "left")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Each row with n / (classes * rows of its class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_m"))
    total = counts.agg(F.sum("_m").alias("_n"), F.count(F.lit(1)).alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("_m"))).alias(out))
    return df.join(weights, label)


def features(numeric: Sequence[str], categories: Sequence[str], out: str = "features") -> Pipeline:
    """Numeric columns beside one-hot categories; categories not seen in fitting become zeros."""
    index = StringIndexer(inputCols=list(categories), outputCols=[f"{c}__i" for c in categories], handleInvalid="keep") if categories else None
    hot = OneHotEncoder(inputCols=[f"{c}__i" for c in categories], outputCols=[f"{c}__v" for c in categories], dropLast=True) if categories else None
    gather = VectorAssembler(inputCols=[*numeric, *[f"{c}__v" for c in categories]], outputCol=out, handleInvalid="keep")
    return Pipeline(stages=[s for s in (index, hot, gather) if s is not None])


def coded(df: DataFrame, categories: Sequence[str], labels: Sequence[Sequence[str]] | None = None) -> tuple[DataFrame, list[list[str]]]:
    """``df`` with '<column>__i', the place of each category among ``labels`` (by default the column's values, the most frequent
    first), or their number for null and unknown ones; and the labels."""
    ways = [StringIndexerModel.from_labels(list(of), c, f"{c}__i", handleInvalid="keep") for c, of in zip(categories, labels, strict=True)] if labels else [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep").fit(df) for c in categories]
    for way in ways:
        df = way.transform(df)
    return df.withColumns({f"{c}__i": F.col(f"{c}__i").cast("int") for c in categories}), [list(way.labels) for way in ways]


def classifier(label: str, trees: int = 100, depth: int = 30, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def probability_of_one(df: DataFrame, out: str = "p1") -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1])


def importances(model: Model, scored: DataFrame, top: int = 15, prefix: str = "") -> DataFrame:
    """feature and importance of the ``top`` most important inputs, best first, by their names without ``prefix``."""
    meta = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    rows = [(names[i], float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    ranked = scored.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)
    return ranked.withColumn("feature", F.replace("feature", F.lit(prefix), F.lit(""))) if prefix else ranked


#: A model with its settings, made for a number of training rows.
Candidates = Mapping[str, Mapping[str, Callable[[int], Estimator]]]


def grids(seed: int = 42) -> dict[str, dict[str, Callable[[int], Estimator]]]:
    """The settings that a search tries, by model; each is made for n training rows, by which a ridge penalty is divided.

    Least rows to split a node (2, 10, 20) have no twin here: half of each is asked of either child, and no limit of depth is 30.
    """
    common = {"labelCol": "log_target", "featuresCol": "features"}
    grown = common | {"seed": seed, "maxMemoryInMB": 1024}  # more nodes in each pass over the rows, with the same trees
    flat = common | {"standardization": False}
    return {
        "linear": {"": lambda n: LinearRegression(**common)},
        "ridge": {f"alpha={a}": lambda n, a=a: LinearRegression(regParam=a / max(n, 1), elasticNetParam=0.0, **flat) for a in (0.1, 1.0, 10.0, 100.0)},
        "lasso": {f"alpha={a}": lambda n, a=a: LinearRegression(regParam=a, elasticNetParam=1.0, maxIter=10_000, **flat) for a in (0.0001, 0.001, 0.01, 0.1)},
        "tree": {f"depth={d}, child={m}": lambda n, d=d, m=m: DecisionTreeRegressor(maxDepth=d, minInstancesPerNode=m, **grown) for d in (10, 15, 20, 30) for m in (1, 5, 10)},
        "forest": {f"trees={t}, depth={d}": lambda n, t=t, d=d: RandomForestRegressor(numTrees=t, maxDepth=d, featureSubsetStrategy="all", **grown) for t in (50, 100) for d in (10, 15, 20)},
        "boosting": {f"rounds={t}, step={e}, depth={d}": lambda n, t=t, e=e, d=d: GBTRegressor(maxIter=t, stepSize=e, maxDepth=d, **grown) for t in (50, 100) for e in (0.05, 0.1) for d in (3, 5, 7)},
    }


def with_log_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a positive target and its logarithm, on which models are fitted; predictions are turned back by exp."""
    return df.where(F.col(target) > 0).withColumn("log_target", F.log(target))


def predict(model: PipelineModel | Model, df: DataFrame, out: str = "predicted") -> DataFrame:
    kept = [c for c in ("prediction",) if c in df.columns]
    return model.transform(df.drop(*kept)).withColumn(out, F.exp("prediction")).drop("prediction")


def time_blocks(df: DataFrame, time: str, blocks: int, out: str = "block") -> DataFrame:
    """Rows in ``blocks`` + 1 consecutive blocks of a numeric time, about equal in rows; equal times share a block."""
    edges = exact_quantiles(df, [], F.col(time), {f"_e{k}": k / (blocks + 1) for k in range(1, blocks + 1)})
    placed = sum(((F.col(time) > F.col(f"_e{k}")).cast("int") for k in range(1, blocks + 1)), F.lit(0))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, placed).drop(*edges.columns)


def expanding_folds(df: DataFrame, time: str, folds: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """Training and validation rows of each fold: all blocks before, and the next block."""
    blocked = time_blocks(df, time, folds)
    return [(blocked.where(F.col("block") < k), blocked.where(F.col("block") == k)) for k in range(1, folds + 1)]


def at_once(spark: SparkSession, work: Callable, tasks: Sequence, threads: int = 16) -> list:
    """``work`` of every task, several at a time: a single fit is a long row of short jobs that leave most of a cluster idle."""
    with ThreadPool(max(1, min(threads, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), tasks, 1)


def leaderboard(train: DataFrame, test: DataFrame, target: str, models: Mapping[str, Estimator], others: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """model, rmse, mae, r2 on the test rows, best first; ``others`` are test rows that a further model has predicted."""
    train = train.cache()
    train.count()
    fitted = at_once(train.sparkSession, lambda pair: (pair[0], pair[1].fit(train)), list(models.items()))
    train.unpersist()
    scored = {name: predict(model, test) for name, model in fitted} | dict(others or {})
    rows = [regression_metrics(rows, F.col(target), F.col("predicted")).select(F.lit(name).alias("model"), "rmse", "mae", "r2") for name, rows in scored.items()]
    return reduce(DataFrame.unionAll, rows).orderBy("rmse")


def search_grids(df: DataFrame, time: str, target: str, candidates: Candidates, folds: int = 5, threads: int = 16) -> DataFrame:
    """model, params, fold, rmse on the original scale, of every setting of every model over expanding folds, ``threads`` fits at a time."""
    held = []
    for k, (train, held_out) in enumerate(expanding_folds(df, time, folds), 1):
        train, held_out = train.cache(), held_out.cache()
        held.append((k, train, held_out, train.count()))

    def score(task):
        (k, train, held_out, n), name, params, make = task
        return name, params, k, regression_metrics(predict(make(n).fit(train), held_out), F.col(target), F.col("predicted")).first()["rmse"]

    # The longest fits, those of the last models and folds, first.
    tasks = [(fold, name, params, make) for name, grid in reversed(candidates.items()) for params, make in reversed(grid.items()) for fold in reversed(held)]
    rows = at_once(df.sparkSession, score, tasks, threads)
    for _, train, held_out, _ in held:
        train.unpersist(), held_out.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, params string, fold int, rmse double")


def best_params(scores: DataFrame) -> DataFrame:
    """Of each model the setting with the least mean rmse over the folds: model, params, mean_rmse, folds."""
    means = scores.groupBy("model", "params").agg(F.avg("rmse").alias("mean_rmse"), F.count(F.lit(1)).alias("folds"))
    best = F.min_by(F.struct("params", "mean_rmse", "folds"), F.struct("mean_rmse", "params"))
    return means.groupBy("model").agg(best.alias("b")).select("model", "b.*")


def best_settings(scores: DataFrame, candidates: Candidates, n: int) -> dict[str, Estimator]:
    """Of each model the best setting, made for n training rows."""
    return {r["model"]: candidates[r["model"]][r["params"]](n) for r in best_params(scores).collect()}


class Stack:
    """Base models whose out-of-fold predictions feed a linear model; bases are refitted on all rows."""

    def __init__(self, bases: Mapping[str, Estimator], folds: int = 5, ridge: float = 1e-3) -> None:
        self.bases, self.folds, self.ridge = dict(bases), folds, ridge

    def fit(self, df: DataFrame, time: str) -> Stack:
        """``df``: features and log_target. Folds are consecutive blocks of ``time``."""
        blocked = time_blocks(df, time, self.folds - 1).cache()
        blocked.count()
        # All blocks but one for each of the out-of-fold models, and all of them for the models that are kept.
        parts = {k: blocked.where(F.col("block") != k) for k in range(self.folds)} | {None: blocked}
        tasks = [(k, name) for name in reversed(self.bases) for k in parts]
        fitted = dict(zip(tasks, at_once(df.sparkSession, lambda task: self.bases[task[1]].fit(parts[task[0]]), tasks), strict=True))
        held = reduce(DataFrame.unionByName, [self._scored({n: fitted[k, n] for n in self.bases}, blocked.where(F.col("block") == k)) for k in range(self.folds)])
        self.meta = LinearRegression(labelCol="log_target", featuresCol="_stacked", regParam=self.ridge).fit(self._gathered(held))
        self.models = {n: fitted[None, n] for n in self.bases}
        blocked.unpersist()
        return self

    @staticmethod
    def _scored(models: Mapping[str, Model], rows: DataFrame) -> DataFrame:
        for name, model in models.items():
            rows = model.transform(rows).withColumnRenamed("prediction", f"_base_{name}")
        return rows

    def _gathered(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=[f"_base_{n}" for n in self.bases], outputCol="_stacked").transform(rows)

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        scored = self.meta.transform(self._gathered(self._scored(self.models, df)))
        return scored.withColumn(out, F.exp("prediction")).drop("prediction", "_stacked", *[f"_base_{n}" for n in self.bases])


def pick_best(prices: Column, chances: Column) -> Column:
    """The entry of two parallel arrays with the highest product, the lowest first entry among ties: price, chance, expected."""
    rows = F.zip_with(prices, chances, lambda p, c: F.struct((p * c).alias("expected"), (-p).alias("low"), p.alias("price"), c.alias("chance")))
    best = F.array_max(rows)
    return F.struct(best["price"].alias("price"), best["chance"].alias("chance"), best["expected"].alias("expected"))


def with_prices(rows: DataFrame, base: str, usual: str) -> DataFrame:
    """Rows whose base and usual price are positive finite numbers."""
    return rows.where(is_finite(F.col(base)) & is_finite(F.col(usual)) & (F.col(base) > 0) & (F.col(usual) > 0))


def price_curve(rows: DataFrame, base: str, usual: str, step: float = 50.0, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Each row with every price of its grid from ``low`` to ``high`` times ``base``: price, and price_ratio to ``usual``.

    Rows whose base or usual price is no positive finite number have no curve.
    """
    points = with_prices(rows, base, usual).withColumn("price", F.explode(value_grid(F.col(base) * low, F.col(base) * high, step)))
    return points.withColumn("price_ratio", F.col("price") / F.col(usual))


def best_prices(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of a curve with ``price`` and ``chance`` the point of each key with the highest revenue, the lowest price among ties."""
    revenue = F.col("price") * F.col("chance")
    best = F.max_by(F.struct("price", "chance", revenue.alias("revenue")), F.struct(revenue, -F.col("price")))
    return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.distributions import chi2_tail, t_tail
from tidemark.operators import modelling as ml
from tidemark.operators import statistics as st
from tidemark.plans import statistics


@pytest.fixture(scope="module")
def sample():
    rnd = random.Random(5)
    return pd.DataFrame({"g": [rnd.choice("abc") for _ in range(400)], "v": [round(rnd.gauss(10, 4), 1) for _ in range(400)]})


def test_tails():
    assert chi2_tail(8.41, 3) == pytest.approx(0.0383, abs=2e-4)
    assert chi2_tail(0, 3) == 1 and chi2_tail(100, 2) == pytest.approx(np.exp(-50))
    assert t_tail(-5.270, 16) == pytest.approx(0.99996, abs=1e-5)
    assert t_tail(0.823, 16) == pytest.approx(0.21134, abs=2e-4)
    assert t_tail(-0.167, 16) == pytest.approx(0.56539, abs=2e-4)
    assert t_tail(0, 5) == pytest.approx(0.5)


def test_describe_like_pandas(spark, sample):
    got = st.describe(spark.createDataFrame(sample), ["v"]).first()
    want = sample.v.describe()
    for a, b in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert got[a] == pytest.approx(want[b])
    assert got["skew"] == pytest.approx(sample.v.skew())


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    row = st.describe(df, ["v"]).first()
    assert row["count"] == 2 and row["mean"] == 2.0
    assert st.within_fences(df, "v").count() == 2
    assert st.describe(df.limit(0), ["v"]).first()["count"] == 0


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles_like_pandas(spark, seed):
    rnd = random.Random(seed)
    values = [lambda: float(rnd.randrange(5)), lambda: rnd.gauss(0, 1e-3), lambda: -rnd.lognormvariate(5, 4), lambda: 0.0, lambda: rnd.uniform(4.5, 5)]
    rows = [(rnd.choice(["a", "b", None]), rnd.choice("xy"), rnd.choice([rnd.choice(values)(), rnd.choice(values)(), None, float("nan")])) for _ in range(700)] + [("solo", "x", 3.0), ("none", "x", None)]
    frame = pd.DataFrame(rows, columns=["g", "h", "v"])
    df = spark.createDataFrame(rows, "g string, h string, v double")
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    got = {(r.g, r.h): r for r in st.exact_quantiles(df, ["g", "h"], F.col("v"), shares).collect()}
    want = frame.dropna().groupby(["g", "h"]).v.quantile(list(shares.values())).unstack()
    assert got.keys() == set(want.index)
    for key, r in got.items():
        assert [r[n] for n in shares] == pytest.approx(list(want.loc[key]), rel=1e-12, abs=1e-15)
    overall = st.exact_quantiles(df, [], F.col("v"), shares).first()
    assert [overall[n] for n in shares] == pytest.approx([frame.v.quantile(q) for q in shares.values()], rel=1e-12)


def test_quantiles_at_the_ends(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (5e-324,)], "v double")
    row = st.exact_quantiles(df, [], F.col("v"), {"a": 0.0, "b": 1.0, "c": 1 / 3}).first()
    assert (row.a, row.b, row.c) == (float("-inf"), float("inf"), 5e-324)
    assert st.exact_quantiles(df.limit(0), [], F.col("v"), {"a": 0.5}).first().a is None
    assert st.exact_quantiles(df.limit(0).withColumn("k", F.lit(1)), ["k"], F.col("v"), {"a": 0.5}).count() == 0


def test_histogram_holds_all_values(spark, sample):
    got = {r.bin: r.n for r in st.histogram(spark.createDataFrame(sample), "v", 10).collect()}
    want, _ = np.histogram(sample.v, 10)
    assert sum(got.values()) == 400 and all(abs(got.get(k + 1, 0) - n) <= 2 for k, n in enumerate(want))
    assert [tuple(r) for r in st.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()] == [(1, 2.0, 2.0, 2)]


def test_ranks_and_tests(spark, sample):
    ranks = sample.v.rank()
    n = len(sample)
    h = 12 / (n * (n + 1)) * sum(ranks[sample.g == g].sum() ** 2 / (sample.g == g).sum() for g in "abc") - 3 * (n + 1)
    ties = sample.v.value_counts()
    h /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    got, p = st.kruskal_test(spark.createDataFrame(sample), "g", "v")
    assert got == pytest.approx(h) and p == pytest.approx(np.exp(-h / 2))
    positive = ranks[sample.g == "a"]
    m = len(positive)
    auc = (positive.sum() - m * (m + 1) / 2) / (m * (n - m))
    assert st.rank_auc(spark.createDataFrame(sample), F.col("g") == "a", F.col("v")).first().auc == pytest.approx(auc)


def test_regression_and_metrics(spark):
    x = np.arange(30.0)
    y = 3 * x + 1 + np.sin(x)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    fit = st.simple_regression(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    assert (fit.slope, fit.intercept, fit.n) == (pytest.approx(slope), pytest.approx(intercept), 30)
    m = st.regression_metrics(df, F.col("y"), F.col("x") * slope + intercept).first()
    residual = y - slope * x - intercept
    assert m.r2 == pytest.approx(1 - (residual**2).sum() / ((y - y.mean()) ** 2).sum()) and m.rmse == pytest.approx((residual**2).mean() ** 0.5)
    t, p = st.paired_t_test(df, F.col("y"), F.col("x") * 3 + 1)
    d = np.sin(x)
    assert t == pytest.approx(d.mean() / (d.std(ddof=1) / 30**0.5)) and 0 < p < 1
    ahead = st.trend_forecast(df, "x", "y", spark.createDataFrame([(40.0,)], "x double")).first()
    assert ahead.low < slope * 40 + intercept < ahead.high


def test_preparation(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 3.0), (None, float("nan"))], "c string, v double")
    scaled = [r.v for r in ml.impute_and_scale(df, ["v"]).collect()]
    assert sum(scaled) == pytest.approx(0) and np.std(scaled) == pytest.approx(1)
    assert [r.c for r in ml.fill_with_mode(df, "c").collect()].count("a") == 3
    assert ml.one_hot_drop_first(df, "c").columns == ["c", "v", "c_b"]
    assert [r.c_b for r in ml.one_hot_drop_first(df, "c").collect()] == [0, 1, 0, 0]
    weights = {r.c: r.weight for r in ml.balanced_weights(df.where("c is not null"), "c").collect()}
    assert weights == {"a": pytest.approx(0.75), "b": pytest.approx(1.5)}


def test_folds_expand_and_stack_learns(spark):
    rnd = random.Random(2)
    rows = [(float(k), rnd.choice("xy"), rnd.uniform(1, 9)) for k in range(600)]
    df = spark.createDataFrame([(t, c, v, 50 + 5 * v + (20 if c == "x" else 0) + rnd.gauss(0, 1)) for t, c, v in rows], "at double, c string, v double, y double")
    folds = ml.expanding_folds(df, "at", 3)
    assert all(a.agg(F.max("at")).first()[0] < b.agg(F.min("at")).first()[0] for a, b in folds)
    assert [a.count() for a, _ in folds] == sorted(a.count() for a, _ in folds)
    logged = ml.with_log_target(df, "y")
    ready = ml.features(["v"], ["c"]).fit(logged).transform(logged)
    models = {"tree": ml.grids()["tree"]["depth=10, child=1"](500), "ridge": ml.grids()["ridge"]["alpha=0.1"](500)}
    stack = ml.Stack(models, folds=3).fit(ready.where("at < 500"), "at")
    assert st.regression_metrics(stack.predict(ready.where("at >= 500")), F.col("y"), F.col("predicted")).first().r2 > 0.9
    unseen = ml.features(["v"], ["c"]).fit(logged).transform(spark.createDataFrame([(1.0, "new", 2.0, 3.0)], "at double, c string, v double, y double"))
    assert list(unseen.first().features.toArray()) == [2.0, 0.0, 0.0]


def test_search_covers_the_grids(spark, monkeypatch):
    grids = ml.grids()
    assert {n: len(g) for n, g in grids.items()} == {"linear": 1, "ridge": 4, "lasso": 4, "tree": 12, "forest": 6, "boosting": 12}
    assert {(e.getNumTrees(), e.getMaxDepth()) for e in (make(1) for make in grids["forest"].values())} == {(t, d) for t in (50, 100) for d in (10, 15, 20)}
    assert {(e.getMaxIter(), e.getStepSize(), e.getMaxDepth()) for e in (make(1) for make in grids["boosting"].values())} == {(t, s, d) for t in (50, 100) for s in (0.05, 0.1) for d in (3, 5, 7)}
    assert grids["ridge"]["alpha=10.0"](200).getRegParam() == 0.05
    rows = ml.with_log_target(spark.range(120).select(F.col("id").cast("double").alias("at"), (F.col("id") % 7).cast("double").alias("x"), F.exp(1 + (F.col("id") % 7) / 5).alias("y")), "y")
    ready = ml.features(["x"], []).fit(rows).transform(rows)
    few = {"ridge": {p: grids["ridge"][p] for p in ("alpha=0.1", "alpha=100.0")}, "linear": grids["linear"]}
    scores = ml.search_grids(ready, "at", "y", few)
    assert {(r.model, r.params, r.fold) for r in scores.collect()} == {(m, p, k) for m, g in few.items() for p in g for k in range(1, 6)}
    assert ml.best_settings(scores, few, 120)["ridge"].getRegParam() == 0.1 / 120
    best = {r.model: r for r in ml.best_params(scores).collect()}
    assert best["ridge"].params == "alpha=0.1" and best["ridge"].folds == 5
    seen = []
    monkeypatch.setattr(statistics.ml, "search_grids", lambda df, time, target, candidates, folds: seen.append((set(candidates), folds)) or scores)
    monkeypatch.setattr(statistics, "_model_rows", lambda spark, d: (None, None))
    # Searched once in a session, whichever query asks first.
    assert statistics.fold_scores(spark, "searched once").count() == statistics.fold_scores(spark, "searched once").count() == scores.count()
    assert seen == [(set(grids), 5)]


def test_columns_of_any_number_of_values(spark):
    df = spark.range(3000).select(F.format_string("v%05d", F.col("id")).alias("c")).unionAll(spark.createDataFrame([(None,)], "c string"))
    got = {r.c: r.at for r in ml.one_hot_array(df, "c", "at").collect()}
    assert len(got) == 3001 and got["v00000"] == -1 and got["v00001"] == 0 and got["v02999"] == 2998 and got[None] is None
    assert len(ml.one_hot_drop_first(df.where("c < 'v01200'"), "c").columns) == 1200


def test_best_price_is_the_peak_of_its_curve(spark):
    rows = spark.createDataFrame([(1, 1200.0, 1000.0), (2, 100.0, 100.0), (3, None, 5.0), (4, float("inf"), 5.0), (5, -3.0, 5.0), (6, 10.0, 0.0)], "id int, base double, usual double")
    curve = ml.price_curve(rows, "base", "usual").withColumn("chance", 1 / (1 + F.exp(3 * (F.col("price_ratio") - 1))))
    points = [(r.id, r.price, r.chance) for r in curve.collect()]
    assert {i for i, *_ in points} == {1, 2} and sorted(p for i, p, _ in points if i == 1) == [600.0 + 50 * k for k in range(37)]
    best = {r.id: r for r in ml.best_prices(curve, ["id"]).collect()}
    for i, r in best.items():
        assert r.revenue == pytest.approx(max(p * c for k, p, c in points if k == i)) and r.price == min(p for k, p, c in points if k == i and p * c == r.revenue)


def test_fliers_and_percent_ranks(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 2, 3, 100]] + [("b", 5.0), (None, 9.0), ("a", None)], "k string, v double")
    assert [(r.k, r.v) for r in st.fliers(df, "k", "v").collect()] == [("a", 100.0)]
    got = sorted(((r.v, r.percent_rank) for r in st.percent_ranks(df, "v").collect()), key=str)
    assert (1.0, 0.0) in got and (100.0, 1.0) in got and (None, None) in got and got.count((2.0, pytest.approx(1 / 6))) == 2

"""Trees in NumPy against brute force, lines against their definition, and that the model queries fit whole grids with them."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_queries import BOUNDS

from tidemark import session
from tidemark.operators import fitting, modelling
from tidemark.operators import trees as tr
from tidemark.plans import statistics


def made(n=300, seed=3):
    rnd = np.random.default_rng(seed)
    numbers, codes = [rnd.integers(0, 9, n).astype(float), rnd.normal(size=n)], [rnd.integers(0, 5, n)]
    y = numbers[0] ** 2 / 9 + numbers[1] * (codes[0] == 2) + rnd.normal(size=n)
    return numbers, codes, y, tr.binned(numbers, codes, [tr.edges_of(v) for v in numbers], [4])


def best_by_hand(data, y, w, least):
    """Least sum of squares over all splits of a node, by trying each."""
    left_out = lambda m: float(np.sum(w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2))
    tried = []
    for c, size in enumerate(data.sizes):
        for s in range(size - 1):
            m = data.cells[c] <= s if c < data.numbers else data.cells[c] == s
            if min(w[m].sum(), w[~m].sum()) >= least:
                tried.append(left_out(m) + left_out(~m))
    return min(tried)


@pytest.mark.parametrize("least", [1, 10])
def test_splits_are_the_best(least):
    _, _, y, data = made()
    w = np.random.default_rng(0).poisson(1.0, len(y)).astype(float)
    tree = tr.grow(data, y, w, 1, least)
    off = np.sum(w * (y - tree.predict(data, [1])[1]) ** 2)
    on = w > 0
    assert off == pytest.approx(best_by_hand(tr.Binned(data.cells[:, on], data.sizes, data.numbers), y[on], w[on], least), rel=1e-5)


def test_blocks_of_nodes_give_the_same_tree(monkeypatch):
    _, _, y, data = made()
    whole = tr.grow(data, y, None, 20)
    monkeypatch.setattr(tr, "CELLS", 100)
    parts = tr.grow(data, y, None, 20)
    assert np.allclose(whole.predict(data, [20])[20], parts.predict(data, [20])[20])


def test_deep_trees_hold_the_shallow_and_rounds_the_fewer():
    _, _, y, data = made()
    deep = tr.grow(data, y, None, 12)
    for d in (0, 1, 4):
        assert np.allclose(deep.predict(data, [d, 12])[d], tr.grow(data, y, None, d).predict(data, [d])[d])
    assert np.allclose(tr.boosted(data, y, data, [3, 9], 0.1, 3)[3], tr.boosted(data, y, data, [3], 0.1, 3)[3])
    reached = np.zeros(len(y), np.int64)
    tree = tr.grow(data, y, None, 6, reached=reached)
    assert np.allclose(tree.value[reached], tree.predict(data, [6])[6])


def test_unlike_codes_and_one_row():
    numbers, codes, y, data = made()
    unseen = tr.binned([v[:5] for v in numbers], [np.full(5, 9)], [tr.edges_of(v) for v in numbers], [4])
    assert np.isfinite(tr.grow(data, y, None, 5).predict(unseen, [5])[5]).all()
    assert tr.grow(tr.Binned(data.cells[:, :1], data.sizes, 2), y[:1], None, 5).value == pytest.approx(y[:1])


@pytest.mark.parametrize("ridge", [0.0, 2.0])
def test_lines(ridge):
    numbers, codes, y, _ = made()
    numbers.append(np.full(len(y), 7.0))  # does not vary, as a category that a fold has not
    line = tr.Linear(numbers, codes, [4], y, block=70)
    x = np.column_stack([*numbers, codes[0][:, None] == np.arange(4)]).astype(float)
    centred = x - x.mean(axis=0)
    want = np.linalg.pinv(centred.T @ centred + ridge * np.eye(x.shape[1])) @ centred.T @ (y - y.mean())
    b = line.fit(ridge)
    assert np.allclose(line.predict(b, numbers, codes), centred @ want + y.mean())
    shrunk = line.fit(lasso=0.05)
    slack = centred.T @ (y - y.mean() - centred @ shrunk) / len(y)
    assert (np.abs(slack) <= 0.05 + 1e-5).all() and np.allclose(slack[shrunk != 0], 0.05 * np.sign(shrunk[shrunk != 0]), atol=1e-5)


def test_grid_is_that_of_the_survey():
    assert {m: {fitting.named(s) for s in of} for m, of in fitting.SETTINGS.items()} == {m: set(of) for m, of in modelling.grids().items()}


def no_spark_models(monkeypatch):
    """Fits of pyspark.ml's trees gather models on the driver and start a job for each level."""
    for name in ("RandomForestClassifier", "RandomForestRegressor", "GBTRegressor", "DecisionTreeRegressor"):
        monkeypatch.setattr(getattr(modelling, name), "fit", lambda *_: pytest.fail("fitted by pyspark.ml"))


@pytest.mark.parametrize("name", ["best_params", "fold_scores", "forecast_leaderboard", "stacking_forecast", "revenue_curve", "booking_model", "optimal_prices", "feature_importance"])
def test_whole_job(spark, data, monkeypatch, name):
    no_spark_models(monkeypatch)
    BOUNDS[name](statistics.QUERIES[name](spark, data).toPandas())


@pytest.mark.parametrize("weighted", [False, True])
def test_columns_counted_at_once_give_the_same_tree(monkeypatch, weighted):
    _, _, y, data = made(4000)
    rnd = np.random.default_rng(1)
    w = rnd.poisson(1.0, len(y)) * np.where(y > 1, 0.3, 2.1) if weighted else None
    grown = lambda: tr.grow(data, y, w, 8, 1e-12 if weighted else 2, 4, np.random.default_rng(5))
    at_once, groups = grown(), tr._groups
    assert any(len(g) > 1 for g in groups(data.sizes, len(y) // 8))
    monkeypatch.setattr(tr, "_groups", lambda sizes, room: groups(sizes, 0))
    assert np.allclose(at_once.predict(data, [8])[8], grown().predict(data, [8])[8])


@pytest.mark.parametrize("weights", ["none", "drawn", "fractions", "unlike"])
@pytest.mark.parametrize("some", [0, 3])
def test_large_nodes_are_counted_by_the_smaller_child(monkeypatch, weights, some):
    """The same trees as by counting all rows of each level, in fewer counts of rows."""
    y, n, rnd = made(6000)[2], 6000, np.random.default_rng(1)
    w = {"none": None, "drawn": rnd.poisson(1.0, n), "fractions": rnd.poisson(1.0, n) * np.where(y > 1, 0.3, 2.1), "unlike": np.where(y > 1, 1e-12, 1.0) * rnd.integers(1, 9, n)}[weights]
    w = None if w is None else w.astype(float)
    grown = lambda reached: tr.grow(made(n)[3], y, w, 7, 1e-13 if weights == "unlike" else 1.0, some, np.random.default_rng(5), reached)
    one, two = np.full((2, n), -1)
    together = grown(one)
    rows = []
    counted = tr._counted
    monkeypatch.setattr(tr, "_counted", lambda data, nodes, *rest: rows.append(sum(map(len, nodes))) or counted(data, nodes, *rest))
    monkeypatch.setattr(tr, "LARGE", 200)
    alone = grown(two)
    assert len(rows) > 3 and (weights == "unlike" or sum(rows[1:]) <= n / 2 * (len(rows) - 1))
    assert (one == two).all() and all(np.allclose(getattr(together, f), getattr(alone, f)) for f in ("column", "split", "left", "value", "gain"))
    data = made(n)[3]
    shown = alone.predict(data, [2, 7])
    monkeypatch.setattr(tr, "LARGE", 4 * n)
    assert all((shown[d] == v).all() for d, v in alone.predict(data, [2, 7]).items())


def test_labels_that_are_all_equal_are_one_leaf(monkeypatch):
    monkeypatch.setattr(tr, "LARGE", 200)
    _, _, y, data = made(4000)
    reached = np.full(4000, -1)
    assert len(tr.grow(data, np.full(4000, 0.1), None, 5, reached=reached).value) == 1 and not reached.any()
    ends = tr.grow(data, y, None, 2, 1500, reached=reached)
    assert np.allclose(ends.value[reached], ends.predict(data, [2])[2])


def test_task_holds_bins_of_a_byte(tmp_path):
    n, rnd = 200_000, np.random.default_rng(0)
    table = {f"n{k}": rnd.normal(size=n) for k in range(6)} | {f"c{k}": rnd.integers(0, 9, n).astype(np.int32) for k in range(2)} | {"y": rnd.normal(size=n), "block": rnd.integers(0, 6, n).astype(np.int32)}
    pq.write_table(pa.table(table), tmp_path / "rows.parquet")
    tracemalloc.start()
    rows = fitting.Rows(str(tmp_path), "block", 5, [9, 9])
    own, held = rows.binned()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.cells.dtype == np.uint8 and own.cells.shape[1] + held.cells.shape[1] == n and peak < 70 * n
    at = table["block"] < 5
    whole = tr.binned([table[f"n{k}"][~at] for k in range(6)], [table[f"c{k}"][~at] for k in range(2)], [tr.edges_of(table[f"n{k}"][at]) for k in range(6)], [9, 9])
    assert (held.cells == whole.cells).all() and (rows.y == table["y"][at]).all()


def test_curve_is_not_kept_and_holds_the_best_prices(spark, data):
    curve = statistics.revenue_curve(spark, data).toPandas()
    best = statistics.optimal_prices(spark, data).toPandas().sort_values("id", ignore_index=True)
    assert all(spark.read.parquet(p).count() < len(curve) / 2 for k, p in session._stored.items() if k[0] == spark.sparkContext.applicationId and k[1].startswith(("booking", "revenue")))
    want = curve.sort_values(["id", "revenue", "price"], ascending=[True, False, True]).groupby("id", as_index=False).first()
    assert (best[want.columns] == want).all(axis=None)
    assert 0 < best.price.nunique() and (curve.revenue == curve.price * curve.chance).all()


def test_chances_by_bins_are_those_of_the_points(spark, data):
    forest, labels, held, _ = statistics._booking(spark, data)
    kinds = [len(v) for v in labels]
    rows = held.select(F.monotonically_increasing_id().alias("id"), *statistics._booking_inputs()).limit(200).localCheckpoint()
    want = {r.id: r.p for r in fitting.forest_chance(rows, forest, kinds, 30, "p").collect()}
    limits = fitting.forest_edges(spark.read.parquet(forest))[0]
    by_bin = fitting.with_chances(rows.withColumn("ratio", F.col("n0")).drop("n0"), forest, kinds, 30, "chances")
    got = {r.id: r.p for r in by_bin.select("id", F.element_at("chances", fitting.bin_of(F.col("ratio"), limits) + 1).alias("p")).collect()}
    assert got == pytest.approx(want)


def test_best_of_grids_in_blocks(spark):
    rows = spark.createDataFrame([(1, 100.0, 120.0, [0.9, 0.4, 0.1]), (2, 30.0, 30.0, [0.0, 0.0, 0.0]), (3, 900.0, 500.0, [0.5, 0.5, 0.5]), (4, 1000.0, 900.0, [0.8, 0.4, 0.2])], "id bigint, base double, usual double, chances array<double>")
    limits = [0.8, 1.25]
    points = modelling.price_curve(rows, "base", "usual").withColumn("chance", F.element_at("chances", fitting.bin_of(F.col("price_ratio"), limits) + 1))
    want = {tuple(r) for r in modelling.best_prices(points, ["id", "base"]).collect()}
    for block in (1, 7, 1_000_000):
        assert {tuple(r) for r in fitting.best_of_grids(rows, limits, block=block).collect()} == want


@pytest.mark.parametrize("large", [200, 4096])
def test_merged_rows_give_the_models_of_all_rows(monkeypatch, tmp_path, large):
    monkeypatch.setattr(tr, "LARGE", large)
    n, rnd = 6000, np.random.default_rng(2)
    table = {"n0": rnd.integers(0, 6, n).astype(float), "n1": rnd.integers(0, 20, n).astype(float), "c0": rnd.integers(0, 4, n).astype(np.int32), "block": rnd.integers(0, 6, n).astype(np.int32)}
    table["y"] = table["n0"] * (table["c0"] == 1) + table["n1"] ** 2 / 99 + rnd.normal(size=n)
    pq.write_table(pa.table(table), tmp_path / "rows.parquet")
    grown = []
    grow = tr.grow
    monkeypatch.setattr(tr, "grow", lambda data, *rest, **more: grown.append(data.cells.shape[1]) or grow(data, *rest, **more))

    def fits():
        rows = fitting.Rows(str(tmp_path), "block", 5, [4])
        tried = [("tree", {"depth": 3, "child": 1}), ("tree", {"depth": 9, "child": 10}), ("forest", {"trees": 10, "depth": 9}), ("boosting", {"rounds": 5, "step": 0.1, "depth": 4})]
        return [v for m, s in tried for _, v in rows.fitted(m, [s], list(range(10)))]

    few = fits()
    at_once = len(grown)
    assert max(grown) <= 6 * 20 * 4
    monkeypatch.setattr(tr, "merged", lambda data: None)
    assert all(np.allclose(a, b) for a, b in zip(few, fits(), strict=True))
    assert min(grown[at_once:]) == (table["block"] < 5).sum()


def test_rows_are_merged_only_where_many_are_equal():
    _, _, _, data = made(50)
    assert tr.merged(data, 0.0) is None
    twice = tr.Binned(np.concatenate([data.cells, data.cells], axis=1), data.sizes, data.numbers)
    once, of = tr.merged(twice)
    assert (once.cells[:, of] == twice.cells).all() and once.cells.shape[1] == len(np.unique(data.cells, axis=1).T)
    many = tr.Binned(np.tile(twice.cells, (30, 1)), data.sizes * 30, data.numbers)  # more joint bins than a number of 8 bytes has
    assert (tr.merged(many)[0].cells[:, tr.merged(many)[1]] == many.cells).all()


def test_a_worker_bins_the_rows_of_a_fold_once(monkeypatch, tmp_path):
    rnd = np.random.default_rng(4)
    pq.write_table(pa.table({"n0": rnd.normal(size=400), "y": rnd.normal(size=400), "block": rnd.integers(0, 6, 400).astype(np.int32)}), tmp_path / "rows.parquet")
    binned, of_rows = [], fitting.Rows.binned
    monkeypatch.setattr(fitting.Rows, "binned", lambda self, *rest: binned.append(1) or of_rows(self, *rest))
    tasks = [t for t in fitting._tasks("block", [1, 2], {m: fitting.SETTINGS[m] for m in ("boosting", "forest", "tree")})]
    assert [t[1] for t in tasks] == [2] * (len(tasks) // 2) + [1] * (len(tasks) // 2)
    for column, fold, model, settings, _ in tasks[::5]:
        list(fitting._kept(str(tmp_path), column, fold, []).fitted(model, settings[:1], [0]))
    assert len(binned) == 2 and len(fitting._last) == 1


def test_first_column_of_one_bin(monkeypatch):
    monkeypatch.setattr(tr, "LARGE", 200)
    _, _, y, data = made(4000)
    plain = tr.grow(data, y, None, 4)
    behind = tr.grow(tr.Binned(np.concatenate([np.zeros_like(data.cells[:1]), data.cells]), [1, *data.sizes], 1 + data.numbers), y, None, 4)
    assert np.allclose(plain.value, behind.value)


def test_search_scores_fits_in_their_tasks(spark, tmp_path, monkeypatch):
    """Only sums over trees of forests leave the tasks, of each depth once; the scores are those of the predictions."""
    n, rnd = 600, np.random.default_rng(6)
    table = {"n0": rnd.normal(size=n), "c0": rnd.integers(0, 4, n).astype(np.int32), "block": rnd.integers(0, 4, n).astype(np.int32)}
    table["y"] = table["n0"] + (table["c0"] == 1) + rnd.normal(size=n)
    table["amount"] = np.exp(table["y"])
    pq.write_table(pa.table(table), tmp_path / "rows.parquet")
    tried = {"ridge": [{"alpha": 1.0}], "tree": [{"depth": d, "child": 5} for d in (2, 5)], "forest": [{"trees": t, "depth": d} for t in (10, 20) for d in (2, 5)], "boosting": [{"rounds": r, "step": 0.1, "depth": 2} for r in (3, 6)]}
    left, each = [], fitting._each
    monkeypatch.setattr(fitting, "_each", lambda *args: left.append(each(*args).localCheckpoint()) or left[0])
    got = {(r.model, r.params, r.fold): r.rmse for r in fitting.search(spark, str(tmp_path), [4], 3, tried).collect()}
    assert {(r.model, r.n) for r in left[0].where("pred is not null").groupBy("model").agg(F.count("*").alias("n")).collect()} == {("forest", 2 * 2 * 3)}
    want = {}
    for fold in (1, 2, 3):
        rows = fitting.Rows(str(tmp_path), "block", fold, [4])
        for model, settings in tried.items():
            for s in settings:
                trees = s.get("trees", 1)
                logs = next(v for _, v in rows.fitted(model, [s], list(range(trees)))) / trees
                want[model, fitting.named(s), fold] = np.sqrt(np.mean((np.exp(logs) - table["amount"][table["block"] == fold]) ** 2))
    assert got == pytest.approx(want)

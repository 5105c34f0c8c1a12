"""Grid search over expanding folds, stacking and forests, each fit of a model in a task of its own over a stored table of rows.

The table holds ``y`` (logarithmic target), ``amount`` (the target), ``block`` and ``part`` (blocks of time for the search and for the
stack, -1 in test rows), numbers ``n0``... and codes of categories ``c0``..., of which the last code of each means none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import trees as tr
from tidemark.session import cut

#: The settings of each model that a search tries, as ``modelling.grids`` names them.
SETTINGS: dict[str, list[dict]] = {
    "linear": [{}],
    "ridge": [{"alpha": a} for a in (0.1, 1.0, 10.0, 100.0)],
    "lasso": [{"alpha": a} for a in (0.0001, 0.001, 0.01, 0.1)],
    "tree": [{"depth": d, "child": m} for d in (10, 15, 20, 30) for m in (1, 5, 10)],
    "forest": [{"trees": t, "depth": d} for t in (50, 100) for d in (10, 15, 20)],
    "boosting": [{"rounds": t, "step": e, "depth": d} for t in (50, 100) for e in (0.05, 0.1) for d in (3, 5, 7)],
}
#: Trees of a forest that one task grows; divides all numbers of trees.
CHUNK = 10
PREDICTED = "model string, params string, fold int, chunk int, n bigint, pred binary"


def named(setting: dict) -> str:
    return ", ".join(f"{k}={v}" for k, v in setting.items())


class Rows:
    """Training and held-out rows of a fold, read a column at a time and binned by the training rows."""

    def __init__(self, path: str, column: str, fold: int, kinds: Sequence[int]) -> None:
        self.path, self.kinds, self.inputs = path, list(kinds), _inputs(path)
        self.train, self.held = _sides(self._read(column), column, fold)
        self.y = self._read("y")[self.train]
        self.bins: tuple | None = None

    def _read(self, column: str) -> np.ndarray:
        return tr.read_rows(self.path, [column])[column]

    def raw(self) -> list[list[list[np.ndarray]]]:
        """Of the training and the held-out rows the numbers and the codes."""
        sides = [[[], []], [[], []]]
        for c in self.inputs:
            values = self._read(c)
            for side, on in zip(sides, (self.train, self.held), strict=True):
                side[c[0] == "c"].append(values[on])
        return sides

    def binned(self, held: bool = True) -> tuple[tr.Binned, tr.Binned]:
        """The training rows and, if asked for, those held out; ``edges`` are kept."""
        self.edges, cells = [], []
        sides = (self.train, self.held) if held else (self.train,)
        for c in self.inputs:
            values = self._read(c)
            if c[0] == "n":
                self.edges.append(tr.edges_of(values[self.train]))
                one = [tr.binned([values[on]], [], self.edges[-1:], []) for on in sides]
            else:
                one = [tr.binned([], [values[on]], [], [self.kinds[int(c[1:])]]) for on in sides]
            cells.append([x.cells for x in one])
        out = []
        for k, on in enumerate(sides):
            whole = tr.empty(self.edges, self.kinds, int(on.sum()))
            for c, of in enumerate(cells):
                whole.cells[c] = of[k][0]
                of[k] = None
            out.append(whole)
        return (*out, None)[:2]

    def fitted(self, model: str, settings: Sequence[dict], trees: Sequence[int]) -> Iterator[tuple[dict, np.ndarray]]:
        """Each setting of a model with its predictions for the held-out rows; of a forest the sums over ``trees``."""
        if model in ("linear", "ridge", "lasso"):
            train, held = self.raw()
            linear = tr.Linear(*train, self.kinds, self.y)
            del train
            for s in settings:
                yield s, linear.predict(linear.fit(**({model: s["alpha"]} if s else {})), *held)
            return
        if self.bins is None:
            own, held = self.binned()
            self.bins = (*(tr.merged(own) or (own, None)), held)
        own, of, held = self.bins
        if model == "tree":
            y, w = (self.y, None) if of is None else tr.summed(of, own.cells.shape[1], self.y, None)
            for child in sorted({s["child"] for s in settings}):
                depths = [s["depth"] for s in settings if s["child"] == child]
                out = tr.grow(own, y, w, max(depths), child).predict(held, depths)
                yield from (({"depth": d, "child": child}, out[d]) for d in depths)
        elif model == "forest":
            depths = sorted({s["depth"] for s in settings})
            sums = {d: np.zeros(held.cells.shape[1]) for d in depths}
            for tree in tr.bagged(own, self.y, trees, max(depths), of=of):
                for d, v in tree.predict(held, depths).items():
                    sums[d] += v
            yield from ((s, sums[s["depth"]]) for s in settings if trees[0] < s["trees"])
        else:
            for step, depth in sorted({(s["step"], s["depth"]) for s in settings}):
                rounds = [s["rounds"] for s in settings if (s["step"], s["depth"]) == (step, depth)]
                yield from (({"rounds": r, "step": step, "depth": depth}, v) for r, v in tr.boosted(own, self.y, held, rounds, step, depth, of).items())


#: The rows that a Python worker has read last: its next task is mostly of the same fold, and bins nothing again.
_last: dict[tuple, Rows] = {}


def _kept(path: str, column: str, fold: int, kinds: Sequence[int]) -> Rows:
    if (path, column, fold) not in _last:
        _last.clear()
        _last[path, column, fold] = Rows(path, column, fold, kinds)
    return _last[path, column, fold]


def _sides(at: np.ndarray, column: str, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Training and held-out rows: of the search the blocks before and the block, of the stack the other parts and the part; of
    fold -1 all training rows and the test rows."""
    if fold < 0:
        return at >= 0, at < 0
    return ((at < fold) & (at >= 0) if column == "block" else (at != fold) & (at >= 0)), at == fold


def _tasks(column: str, folds: Sequence[int], chosen: dict[str, list[dict]]) -> list[tuple]:
    """What each task fits, fold by fold, so that workers keep its rows, of the search the folds of most rows first, and of a fold the
    longest first; of the stack, whose folds are equal, boosting of all folds before the rest."""
    tasks = []
    for fold in folds:
        for model, settings in chosen.items():
            if model == "forest":
                tasks += [(column, fold, model, settings, list(range(k, k + CHUNK))) for k in range(0, max(s["trees"] for s in settings), CHUNK)]
            elif model == "boosting":
                pairs = sorted({(s["step"], s["depth"]) for s in settings})
                tasks += [(column, fold, model, [s for s in settings if (s["step"], s["depth"]) == p], [0]) for p in pairs]
            else:
                tasks.append((column, fold, model, settings, [0]))
    weight = {"boosting": 3, "forest": 2, "tree": 1}
    return sorted(tasks, key=lambda t: (column == "part" and t[2] != "boosting", -t[1], -weight.get(t[2], 0), -max(s.get("depth", 0) for s in t[3])))


def _each(spark: SparkSession, tasks: Sequence[tuple], work, schema: str) -> DataFrame:
    """``work`` of each task, one task of the cluster for each, as rows of ``schema``."""

    def run(batches):
        tr.keep_freed()
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from work(tasks[k])

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema)


def predicted(spark: SparkSession, path: str, kinds: Sequence[int], tasks: Sequence[tuple]) -> DataFrame:
    """The predictions of all tasks for their held-out rows, in the order of the table."""

    def work(task):
        column, fold, model, settings, trees = task
        rows = _kept(path, column, fold, kinds)
        for s, v in rows.fitted(model, settings, trees):
            yield pa.RecordBatch.from_pylist([{"model": model, "params": named(s), "fold": fold, "chunk": trees[0], "n": len(v), "pred": v.astype("<f8").tobytes()}], schema=pa.schema([("model", pa.string()), ("params", pa.string()), ("fold", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("pred", pa.binary())]))

    return _each(spark, tasks, work, PREDICTED)


def _inputs(path: str) -> list[str]:
    """Numbers, then codes."""
    return sorted((c for c in tr.stored(path).schema.names if c[0] in "nc" and c[1:].isdigit()), key=lambda c: (c[0] == "c", int(c[1:])))


def _joined(frame: pd.DataFrame) -> np.ndarray:
    """The predictions of a fit: of a forest the mean over the trees of its chunks."""
    parts = [np.frombuffer(v, "<f8") for v in frame.sort_values("chunk")["pred"]]
    return sum(parts) / (CHUNK * len(parts)) if frame["model"].iloc[0] == "forest" else parts[0]


def search(spark: SparkSession, path: str, kinds: Sequence[int], folds: int = 5, settings: dict[str, list[dict]] | None = None) -> DataFrame:
    """model, params, fold, rmse on the original scale, of every setting of every model over expanding folds.

    Fits are scored in their tasks; only of forests, whose trees come from several tasks, predictions are joined."""
    settings = settings or SETTINGS
    tasks = _tasks("block", range(1, folds + 1), settings)

    def rmse(logs: np.ndarray, amount: np.ndarray) -> float:
        off = np.exp(logs) - amount
        return float(np.sqrt(np.mean(off * off))) if len(off) else np.nan

    def work(task):
        column, fold, model, chosen, trees = task
        rows = _kept(path, column, fold, kinds)
        amount = tr.read_rows(path, ["amount"])["amount"][rows.held]
        forest = model == "forest"
        if forest:  # of each depth the trees once, for forests of any number
            chosen = [{"trees": max(s["trees"] for s in chosen), "depth": d} for d in sorted({s["depth"] for s in chosen if trees[0] < s["trees"]})]
        for s, v in rows.fitted(model, chosen, trees):
            row = {"model": model, "params": named({"depth": s["depth"]} if forest else s), "fold": fold, "chunk": trees[0], "pred": v.astype("<f8").tobytes() if forest else None, "rmse": None if forest else rmse(v, amount)}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("model", pa.string()), ("params", pa.string()), ("fold", pa.int32()), ("chunk", pa.int32()), ("pred", pa.binary()), ("rmse", pa.float64())]))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        model, params, fold = (frame[c].iloc[0] for c in ("model", "params", "fold"))
        if model != "forest":
            return frame[["model", "params", "fold", "rmse"]]
        table = tr.read_rows(path, ["amount", "block"])
        amount = table["amount"][table["block"] == fold]
        found = {named(s): rmse(_joined(frame[frame["chunk"] < s["trees"]]), amount) for s in settings["forest"] if named({"depth": s["depth"]}) == params}
        return pd.DataFrame({"model": model, "params": list(found), "fold": fold, "rmse": list(found.values())})

    fits = _each(spark, tasks, work, "model string, params string, fold int, chunk int, pred binary, rmse double")
    return fits.groupBy("model", "params", "fold").applyInPandas(score, "model string, params string, fold int, rmse double")


def stacked(spark: SparkSession, path: str, kinds: Sequence[int], tuned: dict[str, dict], folds: int, ridge: float, bases: Sequence[str] = ("forest", "boosting", "ridge")) -> DataFrame:
    """model, amount, predicted of the test rows, by each model with its best setting and by a line through the out-of-fold
    predictions of ``bases``."""
    chosen = {m: [s] for m, s in tuned.items()}
    tasks = _tasks("part", [-1], chosen) + _tasks("part", range(folds), {m: chosen[m] for m in bases})

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": frame["model"].iloc[:1], "fold": frame["fold"].iloc[:1], "pred": [_joined(frame).tobytes()]})

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        table = tr.read_rows(path, ["y", "amount", "part"])
        found = {(m, k): np.frombuffer(v, "<f8") for m, k, v in frame[["model", "fold", "pred"]].itertuples(index=False)}
        x, y, part = np.zeros((len(table["y"]), len(bases))), table["y"], table["part"]
        for k in range(folds):
            x[part == k] = np.column_stack([found[m, k] for m in bases])
        x, y = x[part >= 0], y[part >= 0]
        x_mean, y_mean, n = x.mean(axis=0), y.mean(), len(y)
        deviation = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        z = (x - x_mean) / deviation
        b = np.linalg.lstsq(z.T @ z / n + ridge * np.eye(len(bases)), z.T @ (y - y_mean) / n, rcond=None)[0]
        test = np.column_stack([found[m, -1] for m in bases])
        logs = {m: found[m, -1] for m in tuned} | {"stacking": (test - x_mean) / deviation @ b + y_mean}
        actual = table["amount"][part < 0]
        return pd.concat([pd.DataFrame({"model": m, "amount": actual, "predicted": np.exp(v)}) for m, v in logs.items()])

    fits = predicted(spark, path, kinds, tasks).groupBy("model", "fold").applyInPandas(joined, "model string, fold int, pred binary")
    return fits.groupBy().applyInPandas(combine, "model string, amount double, predicted double")


def forest_importances(spark: SparkSession, path: str, kinds: Sequence[int], trees: int = 100, depth: int = 20) -> DataFrame:
    """input (place among numbers, then categories), importance: mean over a forest of the share of each input in the gains."""
    tasks = [("part", -1, "forest", [], list(range(k, k + CHUNK))) for k in range(0, trees, CHUNK)]

    def work(task):
        rows = Rows(path, "part", -1, kinds)
        own, _ = rows.binned(held=False)
        share = reduce(np.add, (tr.importances(t, own) for t in tr.bagged(own, rows.y, task[4], depth)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(share)), pa.int32()), pa.array(share / trees)], names=["input", "importance"])

    sums = cut(_each(spark, tasks, work, "input int, importance double")).groupBy("input").agg(F.sum("importance").alias("importance"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("importance").alias("_all")))).select("input", F.try_divide("importance", "_all").alias("importance"))


def grow_forest(spark: SparkSession, path: str, kinds: Sequence[int], trees: int, depth: int, seed: int = 42, per_task: int = 2) -> DataFrame:
    """tree, edges, nodes (binary): a classifier of ``y`` (0 or 1, weighted by ``weight``), each node split by one of the root of
    the number of inputs. ``edges`` are the limits of the numbers' bins, the same for all trees. No tree reaches the driver."""
    tasks = [list(range(k, min(k + per_task, trees))) for k in range(0, trees, per_task)]
    schema = pa.schema([("tree", pa.int32()), ("edges", pa.list_(pa.list_(pa.float64()))), ("nodes", pa.binary())])

    def work(task):
        rows = Rows(path, "y", -1, kinds)
        own, _ = rows.binned(held=False)
        weight = tr.read_rows(path, ["weight"])["weight"][rows.train]
        some = int(np.ceil(np.sqrt(own.inputs)))
        for t, tree in zip(task, tr.bagged(own, rows.y, task, depth, seed, weight, some), strict=True):
            nodes = pickle.dumps((tree.column.astype(np.int8), tree.split.astype(np.uint16), tree.left, tree.value))
            yield pa.RecordBatch.from_pylist([{"tree": t, "edges": [e.tolist() for e in rows.edges], "nodes": nodes}], schema=schema)

    return _each(spark, tasks, work, "tree int, edges array<array<double>>, nodes binary")


def forest_edges(forest: DataFrame) -> list[list[float]]:
    """The limits of the bins of the numbers of a stored forest."""
    return [list(e) for e in forest.select("edges").first()[0]]


def forest_chance(df: DataFrame, path: str, kinds: Sequence[int], depth: int, out: str, block: int = 1_000_000) -> DataFrame:
    """``df`` with ``out``: the mean over all trees of a stored forest, from its columns n0..., c0..., which are left out.

    Blocks of rows of a partition go through one tree after the other, rows of equal bins once; a task holds one tree at a time.
    """
    inputs = sorted((c for c in df.columns if c[0] in "nc" and c[1:].isdigit()), key=lambda c: (c[0] == "c", int(c[1:])))
    kept = [f for f in df.schema if f.name not in inputs]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` double"

    def chance(table: pa.Table) -> np.ndarray:
        sums, count, data, back = None, 0, None, None
        for batch in tr.stored(path).to_batches(columns=["edges", "nodes"], batch_size=1, batch_readahead=1, fragment_readahead=1):
            for edges, nodes in zip(*batch.columns, strict=True):
                column, split, left, value = pickle.loads(nodes.as_py())
                if data is None:
                    edges = [np.array(e) for e in edges.as_py()]
                    full = tr.binned([table[c].to_numpy() for c in inputs if c[0] == "n"], [table[c].to_numpy() for c in inputs if c[0] == "c"], edges, kinds)
                    key = np.zeros(full.cells.shape[1], np.int64)
                    for c, size in enumerate(full.sizes):
                        key = key * size + full.cells[c]
                    _, first, back = np.unique(key, return_index=True, return_inverse=True)
                    data = tr.Binned(full.cells[:, first], full.sizes, full.numbers)
                    sums = np.zeros(len(first))
                sums += tr.Tree(column, split, left, value, None).predict(data, [depth])[depth]
                count += 1
        return (sums / count)[back]

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                yield from scored(held)
                held, rows = [], 0
        if rows:
            yield from scored(held)

    def scored(held):
        table = pa.Table.from_batches(held)
        yield from table.select([f.name for f in kept]).append_column(out, pa.array(chance(table))).to_batches(max_chunksize=10_000)

    return df.mapInArrow(run, schema)


def bin_of(value: Column, limits: Sequence[float]) -> Column:
    """The place of a value's bin, from 0: how many limits are below it."""
    return reduce(lambda a, b: a + b, [(value > e).cast("int") for e in limits], F.lit(0))


def with_chances(df: DataFrame, path: str, kinds: Sequence[int], depth: int, out: str) -> DataFrame:
    """``df`` with ``out``: the chances by a stored forest at each bin of n0, in order, from its columns n1..., c0..., which are left out.

    So any number of values of n0 are scored by their bins, and rows of equal bins in the other columns once.
    """
    edges = forest_edges(df.sparkSession.read.parquet(path))
    # A value of each bin: its upper limit, which belongs to it, and one above the last.
    values = [[*e, e[-1] + 1.0 if e else 0.0] for e in edges]
    names = sorted(c for c in df.columns if c[0] in "nc" and c[1:].isdigit())
    keyed = df.select("*", *[(bin_of(F.col(c), edges[int(c[1:])]) if c[0] == "n" else F.col(c)).alias(f"_b{c}") for c in names]).drop(*names)
    keys = [f"_b{c}" for c in names]
    value = lambda k, at: F.element_at(F.array(*map(F.lit, values[k])), at + 1)
    points = keyed.select(*keys).distinct().select("*", F.posexplode(F.array(*map(F.lit, values[0]))).alias("_bin", "n0"))
    # So few rows would else be one task's.
    spread = points.repartition(max(12, df.sparkSession.sparkContext.defaultParallelism), *keys, "_bin")
    inputs = spread.select("*", *[(value(int(c[1:]), F.col(f"_b{c}")) if c[0] == "n" else F.col(f"_b{c}")).alias(c) for c in names])
    scored = forest_chance(inputs, path, kinds, depth, "_chance")
    lists = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_bin", "_chance"))).alias("_list"))
    return keyed.join(lists.select(*keys, F.transform("_list", lambda x: x["_chance"]).alias(out)), keys).drop(*keys)


def best_of_grids(df: DataFrame, limits: Sequence[float], step: float = 50.0, low: float = 0.5, high: float = 2.0, block: int = 1_000_000) -> DataFrame:
    """Of each row (id, base, usual, chances) the point of its price grid with the highest revenue, the lowest price among ties: id,
    base, price, chance, revenue. The points are those of ``modelling.price_curve``; no point leaves the task."""
    edges = np.array(limits)

    def best(base: np.ndarray, usual: np.ndarray, many: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, ...]:
        begin = np.concatenate([[0], np.cumsum(many)[:-1]])
        row = np.repeat(np.arange(len(many)), many)
        price = (base * low)[row] + (np.arange(len(row)) - begin[row]) * step
        chance = chances[row, np.searchsorted(edges, price / usual[row], side="left")]
        revenue = price * chance
        top = np.flatnonzero(revenue == np.maximum.reduceat(revenue, begin)[row])
        first = top[np.unique(row[top], return_index=True)[1]]
        return price[first], chance[first], revenue[first]

    def run(batches):
        for batch in batches:
            base, usual = (batch.column(c).to_numpy() for c in ("base", "usual"))
            if not len(base):
                continue
            chances = batch.column("chances").flatten().to_numpy().reshape(len(base), len(edges) + 1)
            many = np.floor((base * high - base * low) / step + 1e-9).astype(np.int64) + 1
            part = np.cumsum(many) // block
            found = [best(base[a:b], usual[a:b], many[a:b], chances[a:b]) for a, b in pairwise([*np.unique(part, return_index=True)[1], len(base)])]
            price, chance, revenue = map(np.concatenate, zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("base"), *map(pa.array, (price, chance, revenue))], names=["id", "base", "price", "chance", "revenue"])

    return df.select("id", "base", "usual", "chances").mapInArrow(run, "id bigint, base double, price double, chance double, revenue double")

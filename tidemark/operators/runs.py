"""Runs of ordered rows: secondary sort, one linear scan of each partition, and joining of what a boundary cut.

Rows are range-partitioned by key and position, so a key that holds a third of all rows is spread over many partitions. Each
partition is sorted and scanned once with constant memory: only the open run is carried from batch to batch. The first and
the last run of a partition may go on in its neighbour; those, at most two for each partition, are joined by the same scan in a
second, small step. All other runs leave the first step finished.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

_SCHEMA = "key string, lo bigint, hi bigint, n bigint, prev_hi bigint, edge boolean, part int, place int"
_ARROW = pa.schema([("key", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("prev_hi", pa.int64()), ("edge", pa.bool_()), ("part", pa.int32()), ("place", pa.int32())])


def _runs_of_batch(keys: pa.Array, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, max_gap: int, carry: tuple | None):
    """Runs of one sorted batch, the carried open run put in front: keys, lo, hi, n, and whether a run is the first of its key."""
    if carry is not None:
        keys, lo, hi, n = pa.concat_arrays([pa.array([carry[0]], pa.string()), keys]), np.r_[carry[1], lo], np.r_[carry[2], hi], np.r_[carry[3], n]
    codes = np.asarray(keys.dictionary_encode().indices)
    new_key = np.r_[True, codes[1:] != codes[:-1]]
    # How far the key's pieces have reached, since a piece may lie within one before it.
    reach = pd.Series(hi).groupby(np.cumsum(new_key)).cummax().to_numpy()
    opens = new_key | np.r_[True, lo[1:] - reach[:-1] > max_gap]
    at = np.flatnonzero(opens)
    last = np.r_[at[1:], len(lo)] - 1
    return keys.take(pa.array(at)), lo[at], reach[last], np.add.reduceat(n, at), new_key[at]


def _scanner(max_gap: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry, carry_prev, seen_first = None, None, False

        def emit(keys, lo, hi, n, prev, edge, place):
            return pa.RecordBatch.from_arrays([keys, pa.array(lo), pa.array(hi), pa.array(n), pa.array(prev, pa.int64()), pa.array(edge), pa.array(np.full(len(lo), part, np.int32)), pa.array(place, pa.int32())], schema=_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            lo, hi, n = (np.asarray(column[c]) for c in ("lo", "hi", "n"))
            key = column["key"].cast(pa.string())
            keys, lo, hi, n, new = _runs_of_batch(key, lo, hi, n, max_gap, carry)
            prev = np.r_[0, hi[:-1]]
            none = new.copy()
            if carry is not None:  # the open run of the last batch keeps what stood before it
                none[0], prev[0] = carry_prev is None, carry_prev or 0
            carry, carry_prev = (keys[-1].as_py(), lo[-1], hi[-1], n[-1]), None if none[-1] else prev[-1]
            done = len(lo) - 1
            if done:
                edge = np.zeros(done, bool)
                if not seen_first:
                    edge[0], seen_first = True, True
                yield emit(keys[:done], lo[:done], hi[:done], n[:done], pa.array(prev[:done], mask=none[:done]), edge, np.where(edge, 0, 1))
        if carry is not None:
            yield emit(pa.array([carry[0]], pa.string()), np.array([carry[1]]), np.array([carry[2]]), np.array([carry[3]]), [carry_prev], np.array([True]), [2])

    return scan


def _joiner(max_gap: int):
    """The edge runs of all partitions in order, those that belong together made one."""

    def batch_of(runs: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*runs, strict=True)) if runs else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4], strict=True)], names=["key", "lo", "hi", "n", "prev_hi"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run = None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if open_run is not None and r["key"] == open_run[0] and r["lo"] - open_run[2] <= max_gap:
                    open_run = (open_run[0], open_run[1], max(open_run[2], r["hi"]), open_run[3] + r["n"], open_run[4])
                    continue
                if open_run is not None:
                    out.append(open_run)
                before = open_run[2] if open_run is not None and open_run[0] == r["key"] and r["prev_hi"] is None else r["prev_hi"]
                open_run = (r["key"], r["lo"], r["hi"], r["n"], before)
            yield batch_of(out)
        yield batch_of([open_run] if open_run is not None else [])

    return join


def _without_reached(pieces: DataFrame, max_gap: int) -> DataFrame:
    """Runs that a piece of an earlier partition reaches over marked as edges, those that lie within it put together.

    How far an earlier partition reaches is known from its last run: one row for each partition.
    """
    edges = pieces.where("edge").select("part", "key", "hi", "place")
    first = edges.groupBy("part").agg(F.min_by("key", "place").alias("_first"))
    reached = edges.where("place = 2").withColumn("_far", F.max("hi").over(Window.partitionBy("key").orderBy("part")))
    ordered = Window.orderBy("part")
    before = reached.select("part", F.lag("key").over(ordered).alias("_key"), F.lag("_far").over(ordered).alias("_far"))
    carried = before.join(first, "part").where("_key = _first").select(F.col("part").alias("_part"), "_key", "_far")
    held = pieces.join(F.broadcast(carried), (F.col("part") == F.col("_part")) & (F.col("key") == F.col("_key")), "left")
    near = F.coalesce(F.col("lo") - F.col("_far") <= max_gap, F.lit(False))
    held = held.withColumn("_within", ~F.col("edge") & near & (F.col("hi") <= F.col("_far"))).withColumn("edge", F.col("edge") | near)
    held = held.withColumn("prev_hi", F.when(near | F.col("prev_hi").isNull(), F.col("prev_hi")).otherwise(F.greatest("prev_hi", "_far")))
    columns = ["key", "lo", "hi", "n", "prev_hi", "edge", "part", "place"]
    inside = held.where("_within").groupBy("key", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    inside = inside.select("key", "lo", "hi", "n", F.lit(None).cast("bigint").alias("prev_hi"), F.lit(True).alias("edge"), "part", F.lit(1).alias("place"))
    return held.where("not _within").select(*columns).unionAll(inside.select(*columns))


def runs_of_sorted(placed: DataFrame, max_gap: int, before: Callable | None = None) -> DataFrame:
    """Runs of rows that are range-partitioned and sorted by key and position; ``before`` maps the batches of a partition first.

    With ``before``, pieces may overlap and lie within each other, as long as they come in order of their begins.
    """
    scan = _scanner(max_gap)
    step = scan if before is None else lambda batches: scan(before(batches))
    # The runs are few beside the rows; written once, they are read twice, and what made them does not run again.
    pieces = cut(placed.mapInArrow(step, _SCHEMA))
    if before is not None:
        pieces = _without_reached(pieces, max_gap)
    edges = pieces.where("edge").repartition(1).sortWithinPartitions("key", "lo", "part", "place").mapInArrow(_joiner(max_gap), "key string, lo bigint, hi bigint, n bigint, prev_hi bigint")
    return pieces.where("not edge").select("key", "lo", "hi", "n", "prev_hi").unionAll(edges)


def coalesce_runs(df: DataFrame, max_gap: int, partitions: int | None = None) -> DataFrame:
    """Runs of the rows (key string, lo bigint, hi bigint, n bigint): key, lo, hi, n, prev_hi.

    Rows of a key, in order of ``lo``, belong to one run while ``lo`` is at most ``max_gap`` beyond the ``hi`` before it. In this
    order ``hi`` must not decrease: points and disjoint pieces fulfil that, overlapping intervals go through ``intervals`` first.
    ``n`` is summed; ``prev_hi`` is where the key's previous run ended, null for its first. Rows with a null key or bound are
    left out; an empty input gives no runs. Ties and repeated rows fall into the same run.
    """
    rows = df.select(F.col("key").cast("string"), F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), F.col("n").cast("bigint")).where("key is not null and lo is not null and hi is not null")
    placed = rows.repartitionByRange(partitions, "key", "lo") if partitions else rows.repartitionByRange("key", "lo")
    return runs_of_sorted(placed.sortWithinPartitions("key", "lo", "hi"), max_gap)

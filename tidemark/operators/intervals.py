"""Continuous periods of overlapping intervals, and the gaps between them.

Each interval is decomposed into canonical dyadic blocks (2^l units long, at multiples of their length). Blocks covered by an
ancestor are removed, pairs of siblings are merged into their parent from the bottom up, and adjacent blocks are put together.
An interval is cut at the borders of aligned stretches, which are block borders anyway, into at most three pieces however long it
is: its ends, and the whole stretches between them, which stay one row of higher blocks. Pieces are range-partitioned by key and
begin, so a key with a third of all rows, even in a single stretch, fills many tasks; each sorted partition is scanned once.
Where a block of an earlier partition covers blocks of a later one, these are removed, and pieces are joined again by ``runs``.

Bounds are doubled: [s, e] becomes the units 2s .. 2e, closed. Intervals that touch share a unit; intervals with time
between them do not, even a single millisecond; an interval of no length is one unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.runs import runs_of_sorted

#: Exponent of the length of a stretch in doubled units: 2^30 half milliseconds are 6.2 days.
STRETCH = 30


def dyadic_blocks(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical blocks of the half-open intervals [lo, hi): group, start, level, each array in no particular order."""
    groups, starts, levels = [], [], []
    lo, hi, group = lo.copy(), hi.copy(), group.copy()
    for level in range(top + 1):
        odd = (lo & 1 == 1) & (lo < hi)
        groups.append(group[odd]), starts.append(lo[odd] << level)
        lo = lo + odd
        odd_end = (hi & 1 == 1) & (lo < hi)
        groups.append(group[odd_end]), starts.append((hi[odd_end] - 1) << level)
        levels.append(np.full(int(odd.sum()) + int(odd_end.sum()), level, np.int64))
        if level < top:
            lo, hi = (lo + 1) >> 1, hi >> 1
            alive = lo < hi
            lo, hi, group = lo[alive], hi[alive], group[alive]
        else:
            lo, hi = lo, hi - odd_end
            if (lo < hi).any():  # several top blocks in a row
                for g, a, b in zip(group[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                    span = np.arange(a, b)
                    groups.append(np.full(len(span), g)), starts.append(span << level), levels.append(np.full(len(span), level, np.int64))
    return np.concatenate(groups), np.concatenate(starts), np.concatenate(levels)


def without_covered(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by group and start, without repeated blocks and blocks that an ancestor covers."""
    order = np.lexsort((-level, start, group))
    group, start, level = group[order], start[order], level[order]
    if not len(start):
        return group, start, level
    # Blocks nest or are apart: one that begins before the greatest end so far lies within the block that has this end.
    ends = start + (np.int64(1) << level)
    rank = np.cumsum(np.r_[0, (group[1:] != group[:-1]).astype(np.int64)])
    base = int(start.min())
    span = int(ends.max()) - base + 1
    reach = np.maximum.accumulate(ends - base + rank * span)
    keep = np.r_[True, (start[1:] - base + rank[1:] * span) >= reach[:-1]]
    return group[keep], start[keep], level[keep]


def merge_siblings(group: np.ndarray, start: np.ndarray, level: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint blocks with every pair of siblings replaced by the parent, again and again, from the lowest level up."""
    out_g, out_s, out_l = [], [], []
    up_g, up_s = np.empty(0, group.dtype), np.empty(0, np.int64)
    for l in range(top + 1):  # noqa: E741
        at = level == l
        g, s = np.r_[group[at], up_g], np.r_[start[at], up_s]
        order = np.lexsort((s, g))
        g, s = g[order], s[order]
        if l < top and len(s) > 1:
            pair = (g[1:] == g[:-1]) & (s[1:] - s[:-1] == 1 << l) & ((s[:-1] >> l) & 1 == 0)
            first = np.r_[pair, False]
            single = ~(first | np.r_[False, pair])
            up_g, up_s, g, s = g[first], s[first], g[single], s[single]
        else:
            up_g, up_s = up_g[:0], up_s[:0]
        out_g.append(g), out_s.append(s), out_l.append(np.full(len(s), l, np.int64))
    return np.concatenate(out_g), np.concatenate(out_s), np.concatenate(out_l)


def adjacent_joined(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of adjacent blocks: group, lo, hi, sorted."""
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], (start + (np.int64(1) << level))[order]
    if not len(start):
        return group, start, end
    opens = np.r_[True, (group[1:] != group[:-1]) | (start[1:] != end[:-1])]
    at = np.flatnonzero(opens)
    return group[at], start[at], end[np.r_[at[1:], len(start)] - 1]


def _cover(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return merge_siblings(*without_covered(*dyadic_blocks(group, lo, hi, top)), top)


def _coverer(top: int):
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces sorted by key and begin; blocks of the stretch still open are carried on, those of finished ones leave.

        Whole stretches pass as they are, as a group of their own.
        """
        carried: tuple | None = None

        def batch_of(keys: pa.Array, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array(lo), pa.array(hi), pa.array(np.ones(len(lo), np.int64))], names=["key", "lo", "hi", "n"])

        def finished() -> pa.RecordBatch:
            name, _, (s, l) = carried  # noqa: E741
            _, a, b = adjacent_joined(np.zeros(len(s), np.int64), s, l)
            return batch_of(pa.array([name] * len(a), pa.string()), a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            keys, lo, hi = column["key"].cast(pa.string()), np.asarray(column["lo"]), np.asarray(column["hi"])
            stretch = np.where(hi - lo >= 1 << top, -1, lo >> top)
            codes = np.asarray(keys.dictionary_encode().indices)
            group = np.cumsum(np.r_[0, ((codes[1:] != codes[:-1]) | (stretch[1:] != stretch[:-1])).astype(np.int64)])
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            names = keys.take(pa.array(first))
            whole = stretch == -1
            blocks = dyadic_blocks(group[~whole], lo[~whole], hi[~whole], top)
            if carried is not None:
                name, at, (s, l) = carried  # noqa: E741
                if name == names[0].as_py() and at == stretch[0] != -1:
                    blocks = tuple(np.r_[a, b] for a, b in zip(blocks, (np.zeros(len(s), np.int64), s, l), strict=True))
                else:
                    yield finished()
                carried = None
            g, s, l = merge_siblings(*without_covered(*blocks), top)  # noqa: E741
            last = (g == group[-1]) if not whole[-1] else np.zeros(len(g), bool)
            if not whole[-1]:
                carried = (names[len(first) - 1].as_py(), stretch[-1], (s[last], l[last]))
            g, a, b = adjacent_joined(g[~last], s[~last], l[~last])
            g, a, b = np.r_[g, group[whole]], np.r_[a, lo[whole]], np.r_[b, hi[whole]]
            order = np.lexsort((a, g))
            if len(g):
                yield batch_of(names.take(pa.array(g[order])), a[order], b[order])
        if carried is not None:
            yield finished()

    return cover


def periods_and_gaps(intervals: DataFrame, key: str, start_ms: str, end_ms: str, max_gap_ms: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """Continuous periods of each ``key`` and the gaps between them: key, kind ('period' or 'gap'), start_ms, end_ms.

    Intervals that overlap, nest or touch belong to one period; an interval of no length counts as a point. Gaps longer than
    ``max_gap_ms`` are left out (all are given where it is None). Rows with a null key, start or end and rows that end before
    they start are left out; repeated rows change nothing; an empty table gives no rows. Other columns are not read.
    ``stretch``: intervals are cut at multiples of 2^stretch half milliseconds.
    """
    rows = intervals.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{start_ms}`").cast("bigint").alias("s"), F.col(f"`{end_ms}`").cast("bigint").alias("e")).where("key is not null and s is not null and e >= s")
    units = rows.select("key", (F.col("s") * 2).alias("lo"), (F.col("e") * 2 + 1).alias("hi"))
    # The first border at or after the begin, and the last one at or before the end.
    up, down = F.shiftleft(F.shiftright(F.col("lo") + ((1 << stretch) - 1), stretch), stretch), F.shiftleft(F.shiftright("hi", stretch), stretch)
    piece = lambda a, b: F.struct(F.col(a).alias("lo"), F.col(b).alias("hi"))
    crossing = F.filter(F.array(piece("lo", "_up"), piece("_up", "_down"), piece("_down", "hi")), lambda p: p["lo"] < p["hi"])
    cut_up = units.select("key", "lo", "hi", up.alias("_up"), down.alias("_down")).select("key", F.inline(F.when(F.col("_up") <= F.col("_down"), crossing).otherwise(F.array(piece("lo", "hi")))))
    placed = cut_up.repartitionByRange("key", "lo").sortWithinPartitions("key", "lo", "hi")
    runs = runs_of_sorted(placed, 0, _coverer(stretch))
    end = F.shiftright(F.col("hi") - 1, 1)
    start = F.shiftright("lo", 1)
    gap_start = F.when(F.col("prev_hi").isNotNull(), F.shiftright(F.col("prev_hi") - 1, 1))
    gap = F.struct(F.lit("gap").alias("kind"), gap_start.alias("start_ms"), start.alias("end_ms"))
    both = runs.select("key", F.inline(F.array(F.struct(F.lit("period").alias("kind"), start.alias("start_ms"), end.alias("end_ms")), gap))).where("start_ms is not null")
    if max_gap_ms is not None:
        both = both.where((F.col("kind") == "period") | (F.col("end_ms") - F.col("start_ms") <= max_gap_ms))
    return both.select(F.col("key").alias(key), "kind", "start_ms", "end_ms")

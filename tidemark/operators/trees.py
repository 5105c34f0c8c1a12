"""Regression trees, forests and boosting on binned columns in NumPy, fitted inside tasks: one task for each model and fold.

Spark's own trees start a job for each level of each tree, whose launch is nearly all of their time on tables of this width. Here
the rows are written once as a table, each task reads them whole, bins the columns as pyspark.ml does (32 bins, by quantiles of
the training rows) one after the other and fits its trees; of a model only what is asked for leaves the task. A task holds its columns
as bins of one byte each and about 70 bytes a row besides. A node of many rows is counted by joint bins of columns that are made once
for all trees, and of two children only the smaller. Rows of equal bins may be merged, with their weights added up.

A tree grown to a depth holds the trees of all lesser depths, and boosting of 100 rounds that of 50; so each is fitted once.
On labels 0 and 1 the variance is half the Gini impurity, so these trees are classification trees too.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

BINS = 32
#: Cells of the histograms that are held at a time.
CELLS = 4_000_000
#: A node with more rows is counted by itself, the others of a level together.
LARGE = 4096


def keep_freed() -> None:
    """What arrays give back stays with this process, where libc can: fresh pages for each array cost as much as filling it."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        return


def stored(path: str):
    """A stored table as Arrow reads it, in a task or on the driver."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    path = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return ds.dataset(place, filesystem=system, format="parquet")


def read_rows(path: str, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns of a stored table, in the order of its files; every reader gets the same order."""
    table = stored(path).to_table(columns=list(columns))
    return {c: table[c].to_numpy() for c in columns}


def edges_of(values: np.ndarray) -> np.ndarray:
    """Ascending limits of at most ``BINS`` bins: between the values where these are few, else quantiles."""
    known = np.unique(values)
    if len(known) <= BINS:
        return (known[1:] + known[:-1]) / 2
    return np.unique(np.quantile(values, np.arange(1, BINS) / BINS, method="inverted_cdf"))


@dataclass
class Binned:
    """Columns as bins: numbers first, then codes of categories, of which the last code stands for none and is never split off."""

    cells: np.ndarray  # columns x rows, uint8, or uint16 where a column has more than 256 bins
    sizes: list[int]  # bins of each column
    numbers: int  # so many columns are ordered
    _joint: tuple | None = field(default=None, init=False, repr=False)
    _whole: np.ndarray | None = field(default=None, init=False, repr=False)

    def joint(self) -> tuple[list[list[int]], list[np.ndarray], np.dtype]:
        """Groups of columns and the joint bins of the rows in these, several groups in a word of 8 bytes that is read at once, and
        the kind of number that each has in a word; made once for all trees."""
        if self._joint is None:
            groups = _groups(self.sizes, LARGE)
            kind = np.dtype(np.uint16 if all(int(np.prod([self.sizes[c] for c in g])) <= 1 << 16 for g in groups) else np.uint32)
            words = [np.zeros(self.cells.shape[1], np.uint64) for _ in range(0, len(groups), 8 // kind.itemsize)]
            for k, group in enumerate(groups):
                key = words[k * kind.itemsize // 8].view(kind)[k % (8 // kind.itemsize) :: 8 // kind.itemsize]
                for c in group:
                    key *= kind.type(self.sizes[c])
                    key += self.cells[c].astype(kind)
            self._joint = groups, words, kind
        return self._joint

    def whole(self) -> np.ndarray:
        """How many rows are in every bin of every column."""
        if self._whole is None:
            self._whole = np.concatenate([np.bincount(c, minlength=size) for c, size in zip(self.cells, self.sizes, strict=True)]).astype(np.float64)
        return self._whole

    @property
    def inputs(self) -> int:
        return self.numbers + sum(s - 1 for s in self.sizes[self.numbers :])


def empty(edges: Sequence[np.ndarray], kinds: Sequence[int], rows: int) -> Binned:
    """Room for ``rows`` binned rows."""
    sizes = [len(e) + 1 for e in edges] + [k + 1 for k in kinds]
    return Binned(np.empty((len(sizes), rows), np.uint8 if max(sizes, default=0) <= 256 else np.uint16), sizes, len(edges))


def binned(numbers: Sequence[np.ndarray], codes: Sequence[np.ndarray], edges: Sequence[np.ndarray], kinds: Sequence[int]) -> Binned:
    out = empty(edges, kinds, len([*numbers, *codes][0]))
    for c, (e, v) in enumerate(zip(edges, numbers, strict=True)):
        out.cells[c] = np.searchsorted(e, v, side="left")
    for c, (k, v) in enumerate(zip(kinds, codes, strict=True), len(edges)):
        out.cells[c] = np.minimum(v, k)
    return out


@dataclass
class Tree:
    """Nodes by level: column split on (-1 for a leaf), its bin, the left child (the right one follows) and the mean."""

    column: np.ndarray
    split: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def predict(self, data: Binned, depths: Sequence[int]) -> dict[int, np.ndarray]:
        """The means at the nodes that rows reach within each of ``depths`` levels."""
        at = np.zeros(data.cells.shape[1], np.int64)
        moving, out = np.arange(len(at)), {}
        flat = data.cells.reshape(-1)
        # Many rows of one node go on together, the others each from its own node.
        large, moving = ([(0, moving)], moving[:0]) if len(moving) > LARGE // 4 else ([], moving)
        for level in range(max(depths) + 1):
            if level in depths:
                for node, rows in large:
                    at[rows] = node
                out[level] = self.value.take(at).astype(np.float64)
            if level == max(depths):
                break
            node = at.take(moving)
            column = self.column.take(node)
            on = np.flatnonzero(column >= 0)
            moving, node, column = moving.take(on), node.take(on), column.take(on)
            if len(moving):
                cell, split = flat.take(column * np.int64(len(at)) + moving), self.split.take(node)
                at[moving] = self.left.take(node) + ~((cell <= split) & ((column < data.numbers) | (cell == split)))
            here, large, few = large, [], [moving]
            for node, rows in here:
                if self.column[node] < 0:
                    at[rows] = node
                    continue
                for child, part in zip((self.left[node], self.left[node] + 1), _parted(data, rows, self.column[node], self.split[node]), strict=True):
                    if len(part) > LARGE // 4:
                        large.append((child, part))
                    else:
                        at[part] = child
                        few.append(part)
            moving = np.concatenate(few)
        return out


def _parted(data: Binned, rows: np.ndarray, column: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a node that go left and right: of a number the bins up to the limit go left, of a category the bin alone."""
    whole = len(rows) == data.cells.shape[1]
    cell = data.cells[column] if whole else data.cells[column].take(rows)
    left = cell <= split if column < data.numbers else cell == split
    if whole:
        return np.flatnonzero(left), np.flatnonzero(~left)
    return rows.take(np.flatnonzero(left)), rows.take(np.flatnonzero(~left))


def _groups(sizes: Sequence[int], room: int) -> list[list[int]]:
    """Columns that are counted at once: those whose bins together make at most ``room`` cells."""
    groups: list[list[int]] = []
    for c in sorted((c for c, size in enumerate(sizes) if size > 1), key=lambda c: -sizes[c]):
        fits = next((g for g in groups if sizes[c] * int(np.prod([sizes[x] for x in g])) <= room), None)
        groups.append([c]) if fits is None else fits.append(c)
    return groups


def _gains(count, held, n, s, least):
    """What splits take off the sum of squares of nodes of weight ``n`` and sum ``s``: parts of weight ``count`` and sum ``held``."""
    rest = n - count
    off = held - count * (s / n)
    bad = np.minimum(count, rest) < least
    rest *= count
    off *= off
    with np.errstate(divide="ignore", invalid="ignore"):
        off /= rest
    off *= n
    off[bad] = -np.inf
    return off


def _best_splits(data: Binned, cells, node, w, wy, total, sums, least, allowed):
    """Of each node the column, bin and gain of its best split, the first column of those that tie; column -1 where there is none.
    ``node`` ascends where the cells of all nodes are too many to be held.

    While nodes are few, several columns are counted in one pass over the rows, by their joint bins, which are then summed up.
    """
    k = len(total)
    best, column, split = np.full(k, -np.inf), np.full(k, -1, np.int16), np.zeros(k, np.int32)
    starts = data.numbers + np.cumsum([0, *[s - 1 for s in data.sizes[data.numbers :]]])
    step = max(1, CELLS // max(data.sizes))
    for low in range(0, k, step):
        high = min(low + step, k)
        a, b = (0, len(node)) if high - low == k else np.searchsorted(node, [low, high])
        n, s = total[low:high, None], sums[low:high, None]
        at, many = np.arange(high - low), high - low
        weight = None if w is None else w[a:b].astype(np.float64)
        for group in _groups(data.sizes, (b - a) // 8 // many):
            shape = [data.sizes[c] for c in group]
            key = (node[a:b] - low).astype(np.int64)
            for c, size in zip(group, shape, strict=True):
                key *= size
                key += cells[c, a:b]
            cells_of = many * int(np.prod(shape))
            joint = [np.bincount(key, v, cells_of).reshape(many, *shape) for v in (weight, wy[a:b])]
            for place, (c, size) in enumerate(zip(group, shape, strict=True), 1):
                others = tuple(x for x in range(1, len(shape) + 1) if x != place)
                count, held = (h.sum(axis=others)[:, : size - 1] if others else h[:, : size - 1] for h in joint)
                if c < data.numbers:
                    count, held = np.cumsum(count, axis=1), np.cumsum(held, axis=1)
                score = _gains(count, held, n, s, least)
                if allowed is not None:
                    # An ordered column is one input, of a column of categories each is one.
                    first = c if c < data.numbers else starts[c - data.numbers]
                    mine = allowed[low:high, first : first + (1 if c < data.numbers else size - 1)]
                    score[~np.broadcast_to(mine, score.shape)] = -np.inf
                top = score.argmax(axis=1)
                value = score[at, top]
                better = (value > best[low:high]) | ((value == best[low:high]) & (c < column[low:high]))
                best[low:high][better], column[low:high][better], split[low:high][better] = value[better], c, top[better]
    return column, split, best


def _counted(data: Binned, nodes: Sequence[np.ndarray], w, wy) -> tuple[np.ndarray, np.ndarray]:
    """Of each node, given by its rows, the weight and the sum in every bin of every column, one column after the other."""
    count, held = np.zeros((2, len(nodes), sum(data.sizes)))
    starts = np.cumsum([0, *data.sizes])
    groups, words, kind = data.joint()
    ones = [c for c, size in enumerate(data.sizes) if size == 1]
    for k, rows in enumerate(nodes):
        # All rows are counted as they stand, and without weights but once.
        whole = len(rows) == data.cells.shape[1]
        sides = [(wy if whole else wy.take(rows), held[k])]
        if w is None and whole:
            count[k] = data.whole()
        else:
            sides.append((w if w is None or whole else w.take(rows), count[k]))
        for c in ones:
            for v, to in sides:
                to[starts[c]] = len(rows) if v is None else v.sum(dtype=np.float64)
        for at, group in enumerate(groups):
            word, place = divmod(at, 8 // kind.itemsize)
            if not place:
                own = (words[word] if whole else words[word].take(rows)).view(kind)
            shape = [data.sizes[c] for c in group]
            key = own[place :: 8 // kind.itemsize].astype(np.intp)
            for v, to in sides:
                joint = np.bincount(key, v, int(np.prod(shape))).reshape(shape)
                for axis, c in enumerate(group):
                    others = tuple(x for x in range(len(shape)) if x != axis)
                    to[starts[c] : starts[c + 1]] = joint.sum(axis=others) if others else joint
    return count, held


def _best_of_counted(data: Binned, count, held, total, sums, least, allowed):
    """``_best_splits`` of nodes whose bins are counted."""
    starts = np.cumsum([0, *data.sizes])
    count, held, last = count.copy(), held.copy(), starts[1:] - 1
    for c in range(data.numbers):
        of = slice(starts[c], starts[c + 1])
        count[:, of], held[:, of] = np.cumsum(count[:, of], axis=1), np.cumsum(held[:, of], axis=1)
    score = _gains(count, held, total[:, None], sums[:, None], least)
    score[:, last] = -np.inf
    if allowed is not None:
        inputs = np.concatenate([*[np.full(size, c) for c, size in enumerate(data.sizes[: data.numbers])], *[np.minimum(np.arange(size), max(size - 2, 0)) + first for size, first in zip(data.sizes[data.numbers :], data.numbers + np.cumsum([0, *[x - 1 for x in data.sizes[data.numbers :]]]), strict=False)]]).astype(int)
        score[~allowed[:, np.minimum(inputs, allowed.shape[1] - 1)]] = -np.inf
    top = score.argmax(axis=1)
    best = score[np.arange(len(top)), top]
    column = np.searchsorted(starts, top, side="right") - 1
    return np.where(np.isfinite(best), column, -1).astype(np.int16), (top - starts[column]).astype(np.int32), best


def grow(data: Binned, y: np.ndarray, w: np.ndarray | None, depth: int, least: float = 1.0, some: int = 0, rnd: np.random.Generator | None = None, reached: np.ndarray | None = None) -> Tree:
    """A tree by least squares of ``y`` with weights ``w`` (0 leaves a row out; none are all 1). ``least``: weight that both children
    have; ``some``: so many inputs, drawn anew for each node, may split it (0 for all). ``reached`` takes the node of each row.

    Nodes of many rows are lists of these, whose bins are counted in the smaller child of each split and are in the other what is
    left of the node's. Rows of smaller nodes are counted together, level by level.
    """
    w = None if w is None else w.astype(np.float32)
    mean = np.average(y, weights=w)
    rows = (np.arange(len(y)) if w is None else np.flatnonzero(w > 0))
    all_w, all_wy = w, y - mean if w is None else w * (y - mean)
    # What is left of a bin by subtraction is empty below this; it is not told from rounding where weights differ too much.
    least_held = 0.5 if w is None else float(w[rows].min()) / 2
    subtracts = w is None or least_held > 1e-9 * w.sum(dtype=np.float64)
    many = max(LARGE, 4 * sum(data.sizes), len(rows) * sum(data.sizes) // CELLS)
    large, bins = {}, {}
    if len(rows) > many and depth:
        large[0], rows = rows, rows[:0]
        count, held = _counted(data, [large[0]], all_w, all_wy)
        bins[0] = count[0], held[0]
    cells = data.cells if len(rows) == len(y) else data.cells.take(rows, axis=1)
    w, wy = None if w is None else all_w[rows], all_wy[rows]
    node = np.zeros(len(rows), np.int64)
    parts, begun, k = [], 0, 1
    for level in range(depth + 1):
        total, sums = (np.bincount(node, v, k).astype(np.float64) for v in (w, wy))
        squares = np.bincount(node, wy * wy if w is None else wy * wy / w, k).astype(np.float64)
        for i, own in large.items():
            # Where bins are counted, the gain of the best split tells whether labels differ.
            total[i], sums[i], squares[i] = (*(b[: data.sizes[0]].sum() for b in bins[i]), np.inf) if i in bins else (len(own) if w is None else all_w.take(own).sum(dtype=np.float64), all_wy.take(own).sum(), 0.0)
        if reached is not None:
            reached[rows] = node + begun
        spread = squares - sums * sums / total
        part = Tree(np.full(k, -1, np.int16), np.zeros(k, np.int32), np.zeros(k, np.int32), (sums / total + mean).astype(np.float32), np.zeros(k))
        parts.append(part)
        begun += k
        ids = np.flatnonzero((spread > 1e-10 * total) & (total >= 2 * least)) if level < depth else np.zeros(0, np.int64)
        if not len(ids):
            if reached is not None:
                for i, own in large.items():
                    reached[own] = i + begun - k
            break
        alone = np.isin(ids, list(large)) if large else np.zeros(len(ids), bool)
        few = np.flatnonzero(~alone)
        place = np.full(k, -1, np.int64)
        place[ids[few]] = np.arange(len(few))
        if len(few) < k:
            node = place.take(node)
            kept = np.flatnonzero(node >= 0)
            kept = None if len(kept) == len(node) else kept
        else:
            kept = None
        if len(few) * max(data.sizes) > CELLS:
            kept = np.argsort(node, kind="stable") if kept is None else kept[np.argsort(node[kept], kind="stable")]
        if kept is not None:
            rows, node, cells, w, wy = rows.take(kept), node.take(kept), cells.take(kept, axis=1), None if w is None else w.take(kept), wy.take(kept)
        allowed = None
        if 0 < some < data.inputs:
            drawn = rnd.random((len(ids), data.inputs))
            allowed = drawn <= np.partition(drawn, some - 1, axis=1)[:, some - 1 : some]
        column, split, gain = np.full(len(ids), -1, np.int16), np.zeros(len(ids), np.int32), np.zeros(len(ids))
        if len(few):
            column[few], split[few], gain[few] = _best_splits(data, cells, node, w, wy, total[ids[few]], sums[ids[few]], least, None if allowed is None else allowed[few])
        if len(lone := np.flatnonzero(alone)):
            count, held = (np.array([bins[i][j] for i in ids[lone]]) for j in (0, 1))
            column[lone], split[lone], gain[lone] = _best_of_counted(data, count, held, total[ids[lone]], sums[ids[lone]], least, None if allowed is None else allowed[lone])
        cut = (column >= 0) & (gain > 1e-11 * total[ids])
        part.column[ids[cut]], part.split[ids[cut]], part.gain[ids[cut]] = column[cut], split[cut], gain[cut]
        child = np.cumsum(cut) * 2 - 2
        part.left[ids[cut]] = begun + child[cut]
        if reached is not None:
            for i, own in large.items():
                if part.column[i] < 0:
                    reached[own] = i + begun - len(total)
        k = 2 * int(cut.sum())
        if not k:
            break
        if not cut[few].all():
            kept = np.flatnonzero(cut[few].take(node))
            rows, node, cells, w, wy = rows.take(kept), node.take(kept), cells.take(kept, axis=1), None if w is None else w.take(kept), wy.take(kept)
        if len(rows):
            of, limit = column[few].astype(np.int64), split[few].astype(cells.dtype)
            cell = cells.reshape(-1).take(of.take(node) * len(rows) + np.arange(len(rows)))
            # Of a number the cells up to the limit go left, of a category the cell alone.
            left = (cell <= limit.take(node)) & (cell >= np.where(of < data.numbers, 0, limit).astype(cells.dtype).take(node))
            node = child[few].take(node) + ~left
        before, counts, large, bins, less = large, bins, {}, {}, []
        wanted: list[tuple[int, np.ndarray, bool, int]] = []  # nodes to be counted: child, rows, whether the other is what is left, parent
        for j in lone[cut[lone]]:
            pair = _parted(data, before[ids[j]], column[j], split[j])
            for i, own in enumerate(pair, int(child[j])):
                if len(own) > many:
                    large[i] = own
                else:
                    less.append((i, own))
            if level + 1 < depth and max(map(len, pair)) > many:
                small = int(len(pair[1]) < len(pair[0]))
                wanted += [(int(child[j]) + small, pair[small], True, int(ids[j]))] if subtracts else [(int(child[j]) + i, own, False, 0) for i, own in enumerate(pair) if len(own) > many]
        if wanted:
            count, held = _counted(data, [own for _, own, _, _ in wanted], all_w, all_wy)
            for (i, _, other, parent), *own in zip(wanted, count, held, strict=True):
                if i in large:
                    bins[i] = own
                if other and i ^ 1 in large:
                    bins[i ^ 1] = rest = [x - y for x, y in zip(counts[parent], own, strict=True)]
                    empty_bins = rest[0] < least_held
                    rest[0][empty_bins], rest[1][empty_bins] = 0.0, 0.0
        if less:
            fresh = np.concatenate([own for _, own in less])
            rows, node = np.concatenate([rows, fresh]), np.concatenate([node, np.repeat(np.array([i for i, _ in less]), [len(own) for _, own in less])])
            cells, wy = np.concatenate([cells, data.cells.take(fresh, axis=1)], axis=1), np.concatenate([wy, all_wy[fresh]])
            w = None if w is None else np.concatenate([w, all_w[fresh]])
    return Tree(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("column", "split", "left", "value", "gain")])


def merged(data: Binned, most: float = 0.75) -> tuple[Binned, np.ndarray] | None:
    """``data`` with rows of equal bins once and the place of each row among them; None where these are more than ``most`` of the rows.

    No split tells such rows apart, so their weights and sums give the trees that the rows give."""
    key, room = np.zeros(data.cells.shape[1], np.int64), 1
    for c, size in enumerate(data.sizes):
        if room * size > 1 << 62:
            known, key = np.unique(key, return_inverse=True)
            room = len(known)
        key *= size
        key += data.cells[c]
        room *= size
    order = np.argsort(key)
    key = key.take(order)
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    if fresh.sum() > most * len(key):
        return None
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return Binned(data.cells.take(order[fresh], axis=1), data.sizes, data.numbers), of


def summed(of: np.ndarray, rows: int, y: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Means and weights of merged rows."""
    weight = np.bincount(of, w, rows).astype(np.float64)
    return np.bincount(of, y if w is None else w * y, rows) / np.where(weight > 0, weight, 1.0), weight


def bagged(data: Binned, y: np.ndarray, trees: Sequence[int], depth: int, seed: int = 42, weight: np.ndarray | None = None, some: int = 0, of: np.ndarray | None = None) -> Iterator[Tree]:
    """The trees of a forest with these numbers, each on rows drawn with repetition as pyspark.ml draws them (Poisson); ``of``: the
    places of the rows in ``data``, where that is merged."""
    for t in trees:
        rnd = np.random.default_rng([seed, t])
        drawn = rnd.poisson(1.0, len(y)).astype(np.float64)
        if not drawn.any():
            drawn[:] = 1.0
        drawn = drawn if weight is None else drawn * weight
        yield grow(data, *((y, drawn) if of is None else summed(of, data.cells.shape[1], y, drawn)), depth, 1.0 if weight is None else 1e-12, some, rnd)


def boosted(data: Binned, y: np.ndarray, held: Binned, rounds: Sequence[int], step: float, depth: int, of: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Predictions for ``held`` after each number of ``rounds``; each round fits a tree to what is left of ``y``. ``of``: the places
    of the rows in ``data``, where that is merged."""
    mean, w = y.mean(), None
    if of is not None:
        y, w = summed(of, data.cells.shape[1], y, None)
    own, other, out = np.full(len(y), mean), np.full(held.cells.shape[1], mean), {}
    reached = np.zeros(len(y), np.int64)
    for r in range(1, max(rounds) + 1):
        tree = grow(data, y - own, w, depth, reached=reached)
        own += step * tree.value[reached]
        other += step * tree.predict(held, [depth])[depth]
        if r in rounds:
            out[r] = other.copy()
    return out


def importances(tree: Tree, data: Binned) -> np.ndarray:
    """Share of each input (numbers, then categories but the last code) in the gains of a tree."""
    out = np.zeros(data.inputs)
    starts = np.concatenate([np.zeros(data.numbers, int), data.numbers + np.cumsum([0, *[s - 1 for s in data.sizes[data.numbers :]]])[:-1]]).astype(int)
    at = tree.column >= 0
    column = tree.column[at]
    np.add.at(out, np.where(column < data.numbers, column, starts[column] + tree.split[at]), tree.gain[at])
    return out / out.sum() if out.sum() > 0 else out


class Linear:
    """Lines through numbers and one-hot codes from their normal equations, which are made of blocks of rows."""

    def __init__(self, numbers: Sequence[np.ndarray], codes: Sequence[np.ndarray], kinds: Sequence[int], y: np.ndarray, block: int = 50_000) -> None:
        self.kinds, self.n = list(kinds), len(y)
        wide = len(numbers) + sum(kinds)
        self.middle, self.y_mean = np.concatenate([[v.mean() for v in numbers], *[np.bincount(np.minimum(c, k), minlength=k + 1)[:k] / len(y) for c, k in zip(codes, kinds, strict=True)]]), y.mean()
        self.gram, self.moment = np.zeros((wide, wide)), np.zeros(wide)
        for low in range(0, len(y), block):
            x = self._dense([v[low : low + block] for v in numbers], [c[low : low + block] for c in codes]) - self.middle
            self.gram += x.T @ x
            self.moment += x.T @ (y[low : low + block] - self.y_mean)

    def _dense(self, numbers, codes):
        return np.column_stack([*numbers, *[(c[:, None] == np.arange(k)).astype(float) for c, k in zip(codes, self.kinds, strict=True)]])

    def fit(self, ridge: float = 0.0, lasso: float = 0.0) -> np.ndarray:
        """Coefficients with the penalties ridge / 2 * b'b on the sum of squares / 2, or lasso * |b| on its mean."""
        if not lasso:
            # Columns that do not vary have no coefficient; without a penalty the others are brought to one scale.
            held = np.flatnonzero(np.diag(self.gram) > 1e-12 * self.n)
            gram, b = self.gram[np.ix_(held, held)], np.zeros(len(self.moment))
            scale = np.ones(len(held)) if ridge else np.sqrt(np.diag(gram))
            b[held] = np.linalg.lstsq(gram / np.outer(scale, scale) + ridge * np.eye(len(held)), self.moment[held] / scale, rcond=None if ridge else 1e-10)[0] / scale
            return b
        b, gram, moment = np.zeros(len(self.moment)), self.gram / self.n, self.moment / self.n
        left = moment.copy()
        for _ in range(10_000):
            most = 0.0
            for j in np.flatnonzero(np.diag(gram) > 1e-15):
                pull = left[j] + gram[j, j] * b[j]
                fresh = np.sign(pull) * max(abs(pull) - lasso, 0.0) / gram[j, j]
                if fresh != b[j]:
                    left -= gram[:, j] * (fresh - b[j])
                    most = max(most, abs(fresh - b[j]) * np.sqrt(gram[j, j]))
                    b[j] = fresh
            if most < 1e-7:
                break
        return b

    def predict(self, b: np.ndarray, numbers, codes, block: int = 50_000) -> np.ndarray:
        parts = [(self._dense([v[i : i + block] for v in numbers], [c[i : i + block] for c in codes]) - self.middle) @ b + self.y_mean for i in range(0, len(numbers[0]), block)]
        return np.concatenate(parts) if parts else np.zeros(0)

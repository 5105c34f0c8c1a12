"""Missing values filled with observed ones: of the same entity, else of a record whose predicted value is near.

Predictive mean matching. A value is predicted from nested group means, each shrunk towards the mean of the wider group, and a
linear regression of what they leave on numeric columns. Both come from one partial aggregation, a row of sums for each group;
one row of sums reaches the driver. Donors and recipients of all fields are range-partitioned by prediction, equal predictions
by the hash of their id, so that a dense range or a single value fills many tasks. One scan of each sorted partition gives its
recipients the donors nearest to them. A recipient near the border of a partition looks among the border donors of all
partitions, of which there are at most 4 * slots for each partition and field. Every observed row is a donor. A recipient copies the
observed value of one of its nearest donors, drawn by the hash of its id, and the donor's id.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Most partitions of the order of predictions, and nearest donors of which one is drawn.
CELLS, SLOTS = 2048, 16
_RESOLVED, _ASKING, _BORDER = 0, 1, 2


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, null being equal to null, with the right side's keys dropped."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    return left.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])


def _sums(rows: DataFrame, keys: Sequence[str], features: Sequence[Sequence[str]]) -> DataFrame:
    """For each group and field f: count, sum and products of the observed values and of their features."""
    wanted = []
    for f, names in enumerate(features):
        y = F.col(f"_y{f}")
        known = lambda c, y=y: F.sum(F.when(y.isNotNull(), c))
        wanted += [F.count(y).alias(f"_n{f}"), F.coalesce(F.sum(y), F.lit(0.0)).alias(f"_s{f}")]
        for i, a in enumerate(names):
            wanted += [known(F.col(a)).alias(f"_x{f}_{i}"), known(F.col(a) * y).alias(f"_xy{f}_{i}")]
            wanted += [known(F.col(a) * F.col(b)).alias(f"_xx{f}_{i}_{j}") for j, b in enumerate(names) if j >= i]
    return rows.groupBy(*keys).agg(*wanted)


def _with_means(sums: DataFrame, keys: Sequence[str], fields: int, shrink: float) -> DataFrame:
    """The sums of the narrowest groups with their shrunk means _m0, _m1, ...; null where nothing is observed at all."""
    means = lambda m: [((F.col(f"_s{f}") + shrink * F.col(f"_m{f}")) / (F.col(f"_n{f}") + shrink)).alias(m.format(f)) for f in range(fields)]
    wider = sums.groupBy().agg(*[F.try_divide(F.sum(f"_s{f}"), F.sum(f"_n{f}")).alias(f"_m{f}") for f in range(fields)])
    for depth in range(1, len(keys)):
        table = sums.groupBy(*keys[:depth]).agg(*[F.sum(f"_{c}{f}").alias(f"_{c}{f}") for f in range(fields) for c in "ns"])
        wider = _null_safe(table, wider, keys[: depth - 1], "left").select(*keys[:depth], *means("_m{}"))
    return _null_safe(sums, wider, keys[:-1], "left").withColumns({f"_m{f}": m for f, m in enumerate(means("_m{}"))}) if keys else sums.crossJoin(F.broadcast(wider))


def _regressions(groups: DataFrame, sizes: Sequence[int]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each field the mean residual, the means of the features and their coefficients, by slightly ridged normal equations."""
    wanted: list[Column] = []
    for f, size in enumerate(sizes):
        left = lambda total, factor, f=f: F.sum(F.col(total) - F.col(f"_m{f}") * F.col(factor))
        wanted += [F.sum(f"_n{f}"), left(f"_s{f}", f"_n{f}"), *[F.sum(f"_x{f}_{i}") for i in range(size)], *[left(f"_xy{f}_{i}", f"_x{f}_{i}") for i in range(size)]]
        wanted += [F.sum(f"_xx{f}_{i}_{j}") for i in range(size) for j in range(i, size)]
    row = iter([float(v or 0) for v in groups.agg(*[c.alias(f"c{k}") for k, c in enumerate(wanted)]).first()])
    out = []
    for size in sizes:
        n, r = next(row), next(row)
        x, xr = np.array([next(row) for _ in range(size)]), np.array([next(row) for _ in range(size)])
        second = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                second[i, j] = second[j, i] = next(row)
        if not n or not size:
            out.append((r / n if n else 0.0, x, np.zeros(size)))
            continue
        a = second / n - np.outer(x, x) / n**2
        out.append((r / n, x / n, np.linalg.solve(a + np.eye(size) * (1e-9 + 1e-6 * max(np.trace(a), 1e-12)), xr / n - x * r / n**2)))
    return out


def _drawn(known_p: np.ndarray, p: np.ndarray, before: np.ndarray, draw: np.ndarray, slots: int) -> np.ndarray:
    """The place of the donor each recipient copies: one of the ``slots`` nearest, -1 if there is no donor.

    ``known_p``: predictions of the donors in order; ``before``: how many of them precede the recipient. The nearest are among
    the ``slots`` before and the ``slots`` after it; of equally near ones the nearer in order, then the earlier, come first.
    """
    steps = np.array([s for k in range(slots) for s in (-k - 1, k)])
    out = np.full(len(p), -1, np.int64)
    size = max(1, 4_000_000 // len(steps))
    for a in range(0, len(p) if len(known_p) else 0, size):
        at = before[a : a + size, None] + steps
        held = (at >= 0) & (at < len(known_p))
        at = np.clip(at, 0, len(known_p) - 1)
        far = np.where(held, np.abs(known_p[at] - p[a : a + size, None]), np.inf)
        nearest = np.argsort(far, axis=1, kind="stable")[:, :slots]
        choice = np.mod(draw[a : a + size] >> 17, np.minimum(held.sum(axis=1), slots))
        rows = np.arange(len(at))
        out[a : a + size] = at[rows, nearest[rows, choice]]
    return out


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    field, p, h = (table.column(c).to_numpy() for c in ("field", "_p", "_h"))
    return field, p, h, table.column("_y").is_null().to_numpy()


def _piece(kind: int, rows: pa.Table, donors: pa.ChunkedArray, values: pa.ChunkedArray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(rows), kind, np.int32)), *[rows.column(c).combine_chunks() for c in ("field", "_p", "_h", "_id", "_e")], donors.combine_chunks(), values.combine_chunks()]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "field", "_p", "_h", "_id", "_e", "donor_id", "value"])


def _matcher(slots: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by field, prediction, hash and id: recipients with their donors, recipients near a border, border donors."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        field, p, h, missing = _arrays(table)
        ends = np.flatnonzero(np.r_[True, field[1:] != field[:-1], True])
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            known, asking = a + np.flatnonzero(~missing[a:b]), a + np.flatnonzero(missing[a:b])
            before = np.searchsorted(known, asking)
            inner = (before >= slots) & (before <= len(known) - slots)
            found = _drawn(p[known], p[asking[inner]], before[inner], h[asking[inner]], slots)
            donors = table.take(pa.array(known[found]))
            yield _piece(_RESOLVED, table.take(pa.array(asking[inner])), donors.column("_id"), donors.column("_y"))
            left = table.take(pa.array(asking[~inner]))
            yield _piece(_ASKING, left, pa.chunked_array([pa.nulls(len(left), table.schema.field("_id").type)]), pa.chunked_array([pa.nulls(len(left), pa.float64())]))
            border = table.take(pa.array(known if len(known) <= 4 * slots else np.r_[known[: 2 * slots], known[-2 * slots :]]))
            yield _piece(_BORDER, border, border.column("_id"), border.column("_y"))

    return match


def _border_matcher(shared, slots: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Recipients near a border, in any order, with their donors among the border donors of all partitions."""
        border = shared.value
        of, border_p, border_h = (border.column(c).to_numpy() for c in ("field", "_p", "_h"))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            field, p, h = (rows.column(c).to_numpy() for c in ("field", "_p", "_h"))
            place = np.full(len(rows), -1, np.int64)
            for f in np.unique(field):
                here, donors = np.flatnonzero(field == f), np.flatnonzero(of == f)
                order = np.lexsort((np.r_[np.zeros(len(donors)), np.ones(len(here))], np.r_[border_h[donors], h[here]], np.r_[border_p[donors], p[here]]))
                asks = order >= len(donors)
                before = np.empty(len(here), np.int64)
                before[order[asks] - len(donors)] = np.cumsum(~asks)[asks]
                ranked = donors[order[~asks]]
                found = _drawn(border_p[ranked], p[here], before, h[here], slots)
                if len(ranked):
                    place[here] = ranked[found]
            taken = pa.array(place, mask=place < 0)
            yield _piece(_RESOLVED, rows, border.column("donor_id").take(taken), border.column("value").take(taken))

    return match


def impute_fields(
    df: DataFrame,
    row_id: str,
    fields: Mapping[str, tuple[Column, Mapping[str, Column]]],
    entity: str | None,
    recency: str | None,
    groups: Sequence[str],
    shrink: float = 20.0,
    cells: int = CELLS,
    slots: int = SLOTS,
    keep_observed: bool = True,
) -> DataFrame:
    """Observed and filled values: row_id, field, value, filled, donor_id, how ('observed', 'same_entity', 'similar' or null).

    ``fields``: by name, the observed value as a double, null or NaN where it is missing, and the features that predict it. A
    missing value is copied from the latest observed row of the same ``entity`` (by ``recency``, then row id), else from one of the
    ``slots`` donors with the nearest predictions. ``groups`` go from the widest key to the narrowest, nulls being a group of
    their own; a feature that is null or NaN counts as 0 (give a mark of its absence as a further feature where that matters). Of
    equal rows each gets its own result. If nothing is observed, missing values stay null with filled = false. An empty table
    gives no rows. Columns of ``df`` that are not named are not read. Without ``keep_observed`` only the rows whose value is
    missing are given. All fields are fitted by one scan and filled by one shuffle; group means and regression are written or
    read when the result is built, not when it is used. A partition of that shuffle is held in memory as arrays.
    """
    number = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    unique: dict[str, str] = {}
    names: list[list[str]] = []
    inputs: list[Column] = []
    for _, features in fields.values():
        names.append([])
        for name, c in features.items():
            if name not in unique:
                unique[name] = f"_f{len(unique)}"
                inputs.append(F.coalesce(number(c), F.lit(0.0)).alias(unique[name]))
            names[-1].append(unique[name])
    keys = [f"_g{k}" for k in range(len(groups))]
    rows = df.select(
        F.col(f"`{row_id}`").alias("_id"), *[number(y).alias(f"_y{f}") for f, (y, _) in enumerate(fields.values())], *[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys, strict=True)],
        *inputs, (F.col(f"`{entity}`") if entity else F.lit(None).cast("string")).alias("_e"), (F.col(f"`{recency}`") if recency else F.lit(0)).alias("_t"),
    )
    count = len(fields)
    fitted = cut(_with_means(cut(_sums(rows, keys, names)), keys, count, shrink))  # a row for each group, of all groups there are
    regressions = _regressions(fitted, [len(n) for n in names])

    scored = _null_safe(rows, fitted.select(*keys, *[f"_m{f}" for f in range(count)]), keys, "left")
    each = []
    for f, (level, means, beta) in enumerate(regressions):
        linear = reduce(Column.__add__, [(F.col(n) - float(m)) * float(b) for n, m, b in zip(names[f], means, beta, strict=True)], F.lit(float(level)))
        each.append(F.struct(F.lit(f).alias("field"), F.nanvl(F.coalesce(F.col(f"_m{f}") + linear, F.lit(0.0)), F.lit(0.0)).alias("_p"), F.col(f"_y{f}").alias("_y")))
    stacked = scored.select("_id", "_e", F.inline(F.array(*each))).select("field", "_p", F.xxhash64("_id").alias("_h"), "_id", "_y", F.when(F.col("_y").isNull(), F.col("_e")).alias("_e"))
    parts = max(1, min(cells, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kinds = {x.name: x.dataType.simpleString() for x in stacked.schema}
    schema = f"kind int, field int, _p double, _h bigint, _id {kinds['_id']}, _e {kinds['_e']}, donor_id {kinds['_id']}, value double"
    # Written once: border donors, recipients near borders and all others are read from one and the same partitioning.
    pieces = cut(stacked.repartitionByRange(parts, "field", "_p", "_h").sortWithinPartitions("field", "_p", "_h", "_id").mapInArrow(_matcher(slots), schema))
    # At most 4 * slots donors for each partition and field.
    border = pieces.where(F.col("kind") == _BORDER).select("field", "_p", "_h", "donor_id", "value").toArrow()
    shared = df.sparkSession.sparkContext.broadcast(border)
    at_border = pieces.where(F.col("kind") == _ASKING).select("field", "_p", "_h", "_id", "_e").mapInArrow(_border_matcher(shared, slots), schema)
    lost = pieces.where(F.col("kind") == _RESOLVED).unionAll(at_border).select("field", "_id", "_e", F.when(F.col("donor_id").isNotNull(), F.struct(F.col("donor_id").alias("_id"), F.col("value").alias("_y"))).alias("_like"))
    if entity:
        own = [F.max_by(F.struct(F.col("_id"), F.col(f"_y{f}").alias("_y")), F.when(F.col(f"_y{f}").isNotNull(), F.struct("_t", "_id", f"_y{f}"))) for f in range(count)]
        latest = rows.where(F.col("_e").isNotNull() & reduce(Column.__or__, [F.col(f"_y{f}").isNotNull() for f in range(count)])).groupBy("_e").agg(F.array(*own).alias("_owned"))
        lost = lost.join(latest, "_e", "left").withColumn("_own", F.get("_owned", F.col("field")))
    else:
        lost = lost.withColumn("_own", F.when(F.lit(False), F.col("_like")))
    name = F.element_at(F.array(*[F.lit(n) for n in fields]), F.col("field") + 1)
    how = F.when(F.col("_own").isNotNull(), "same_entity").when(F.col("_like").isNotNull(), "similar")
    taken = F.coalesce("_own", "_like")
    out = lost.select(F.col("_id").alias(row_id), name.alias("field"), taken["_y"].alias("value"), taken.isNotNull().alias("filled"), taken["_id"].alias("donor_id"), how.alias("how"))
    if keep_observed:
        kept = rows.select("_id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"_y{f}").alias("value")) for f, n in enumerate(fields)]))).where("value is not null")
        out = out.unionAll(kept.select("_id", "field", "value", F.lit(False), F.lit(None).cast(kinds["_id"]), F.lit("observed")))
    return out


def impute_pmm(df: DataFrame, row_id: str, target: Column, entity: str | None, recency: str | None, groups: Sequence[str], features: Mapping[str, Column], **settings) -> DataFrame:
    """``impute_fields`` of a single field: row_id, value, filled, donor_id, how."""
    return impute_fields(df, row_id, {"value": (target, features)}, entity, recency, groups, **settings).drop("field")

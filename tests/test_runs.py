import random

import pytest

from tidemark.operators.intervals import adjacent_joined, dyadic_blocks, merge_siblings, periods_and_gaps, without_covered
from tidemark.operators.runs import coalesce_runs
from tidemark.operators.sessions import sessionize


def sessions_of(rows, gap):
    out, last = [], {}
    for key, t in sorted(r for r in rows if None not in r):
        if key in last and t - last[key][2] <= gap:
            last[key][2], last[key][3] = t, last[key][3] + 1
        else:
            last[key] = [key, t, t, 1]
            out.append(last[key])
    return sorted(map(tuple, out))


def periods_of(rows, longest):
    out = []
    for key in sorted({r[0] for r in rows if r[0] is not None}):
        spans = sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and e >= s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", s, e) for s, e in merged]
        out += [(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if longest is None or b[0] - a[1] <= longest]
    return sorted(out)


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed", range(4))
def test_sessions_across_many_partitions(spark, uncoalesced, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([None, *(rnd.randrange(0, 3000) for _ in range(9))])) for _ in range(900)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k string, t bigint, key string, lo int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = sorted(tuple(r) for r in sessionize(df, "k", "t", 7).select("k", "start_ms", "end_ms", "event_count").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sessions_of(rows, 7)


def test_one_key_one_run_over_all_partitions(spark, uncoalesced):
    df = spark.range(2000).selectExpr("'hot' as key", "id as lo", "id as hi", "1 as n")
    assert [tuple(r) for r in coalesce_runs(df, 1, 17).collect()] == [("hot", 0, 1999, 2000, None)]


def test_gap_of_exactly_the_limit_joins(spark):
    df = spark.createDataFrame([("a", 0), ("a", 120), ("a", 241), ("a", 241)], "k string, t bigint")
    assert sorted(tuple(r) for r in sessionize(df, "k", "t", 120).collect()) == [("a", 0, 120, 120, 2), ("a", 241, 241, 0, 2)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, s bigint, e bigint")
    assert sessionize(none, "k", "s", 1).count() == 0
    assert periods_and_gaps(none, "k", "s", "e").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_periods_against_a_sweep(spark, uncoalesced, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(500):
        s = rnd.randrange(-500, 4000)
        rows.append((rnd.choice(["a", "a", "b", None]), rnd.choice([s, s, s, None]), s + rnd.choice([-3, 0, 0, 1, 2, 5, 9, 700 if rnd.random() < 0.02 else 4])))
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, s bigint, e bigint, stretch string")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = sorted(tuple(r) for r in periods_and_gaps(df, "k", "s", "e", 12, stretch=6).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == periods_of(rows, 12)
    assert sorted(tuple(r) for r in periods_and_gaps(df, "k", "s", "e").collect()) == periods_of(rows, None)


def test_touching_nested_and_points(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 3, 4), ("a", 21, 21), ("a", 21, 21), ("a", 30, 30), ("a", 29, 31), ("a", 50, 40)]
    got = sorted(tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, "k string, s bigint, e bigint"), "k", "s", "e").collect())
    assert got == [("a", "gap", 20, 21), ("a", "gap", 21, 29), ("a", "period", 0, 20), ("a", "period", 21, 21), ("a", "period", 29, 31)]


def test_blocks_are_canonical():
    import numpy as np

    rnd = random.Random(1)
    lo = np.array([rnd.randrange(0, 900) for _ in range(60)])
    hi = np.array([rnd.randrange(a + 1, 1025) for a in lo])
    group = np.array([rnd.randrange(3) for _ in lo])
    g, s, l = dyadic_blocks(group, lo, hi, 10)
    assert (s % (1 << l) == 0).all() and len(s) <= 60 * 20
    for k in range(3):
        truth = {x for a, b, q in zip(lo, hi, group) if q == k for x in range(a, b)}
        assert {x for a, n, q in zip(s, l, g) if q == k for x in range(a, a + (1 << n))} == truth
        kept = without_covered(g, s, l)
        merged = merge_siblings(*kept, 10)
        blocks = [(a, n) for q, a, n in zip(*merged) if q == k]
        assert sum(1 << n for _, n in blocks) == len(truth)  # disjoint, nothing lost
        assert not any((a ^ (1 << n), n) in blocks for a, n in blocks if n < 10)  # no siblings left
        spans = [(a, b) for q, a, b in zip(*adjacent_joined(*merged)) if q == k]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_an_interval_of_any_length_is_three_rows(spark, uncoalesced):
    # A mistyped year makes one visit last for 8,000 years; a third of all others belong to one nurse and lie within one stretch.
    rows = [("hot", k * 10, k * 10 + 4) for k in range(400)] + [(f"n{k % 40}", k * 10**8, k * 10**8 + 10**9) for k in range(800)] + [("n7", 5, 253_402_300_799_999), ("late", 253_402_300_799_000, 253_402_300_799_999)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = periods_and_gaps(df, "k", "s", "e")
        assert sorted(tuple(r) for r in found.collect()) == periods_of(rows, None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", range(3))
def test_long_blocks_over_partition_borders(spark, uncoalesced, seed):
    rnd = random.Random(seed + 50)
    rows = [(rnd.choice("ab"), s := rnd.randrange(3000), s + rnd.choice([1, 3, 20, 90, 400, 1500])) for _ in range(150)] + [("a", k, k) for k in range(5000, 9000, 7)] + [("a", 5500, 8000), ("a", 8300, 8301)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    try:
        assert sorted(tuple(r) for r in periods_and_gaps(df, "k", "s", "e", stretch=5).collect()) == periods_of(rows, None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

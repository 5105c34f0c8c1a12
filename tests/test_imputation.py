import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.imputation import impute_fields, impute_pmm
from tidemark.plans import problems
from tidemark.session import cut, load

SCHEMA = "rid bigint, e string, t int, g string, h string, x double, y double, _id string, _p int, value string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, "v") for r in rows], SCHEMA)


def run(df, **kw):
    return {r.rid: r for r in impute_pmm(df, "rid", F.col("y"), "e", "t", ["g", "h"], {"x": F.col("x")}, **kw).collect()}


def test_same_entity_then_similar(spark):
    rows = [(k, f"e{k}", 0, "a" if k % 2 else "b", "h", float(k % 7), (10.0 if k % 2 else 50.0) + k % 7) for k in range(200)]
    rows += [(1000, "e3", 1, "a", "h", 3.0, None), (1001, "new", 1, "a", "h", 2.0, None), (1002, "new2", 1, "b", "h", 5.0, float("nan")), (1003, None, None, None, None, None, None)]
    got = run(table(spark, rows))
    assert len(got) == 204
    assert (got[1000].how, got[1000].donor_id, got[1000].value) == ("same_entity", 3, 13.0)
    assert got[1001].how == "similar" and got[1001].filled and abs(got[1001].value - 12) <= 2
    assert got[1002].how == "similar" and abs(got[1002].value - 55) <= 2
    assert got[1003].how == "similar" and got[1003].value is not None
    by_id = {r[0]: r[6] for r in rows}
    assert all(r.value == by_id[r.donor_id] for r in got.values() if r.filled)
    assert run(table(spark, rows), keep_observed=False) == {k: r for k, r in got.items() if k >= 1000}
    assert all(r.how == "observed" and not r.filled and r.donor_id is None for k, r in got.items() if k < 1000)


def test_latest_of_the_entity(spark):
    got = run(table(spark, [(1, "e", 1, "a", "h", 0.0, 1.0), (2, "e", 5, "a", "h", 0.0, 2.0), (3, "e", 5, "a", "h", 0.0, 3.0), (4, "e", 3, "a", "h", 0.0, None)]))
    assert (got[4].value, got[4].donor_id) == (3.0, 3)


def test_nothing_observed_and_empty(spark):
    got = run(table(spark, [(1, "e", 1, "a", "h", 0.0, None), (2, None, 1, "a", "h", None, None)]))
    assert all(r.value is None and not r.filled and r.how is None for r in got.values())
    assert run(table(spark, [])) == {}


def test_repeated_rows_each_get_a_row(spark):
    df = table(spark, [(1, "e", 1, "a", "h", 0.0, 4.0), (2, "f", 1, "a", "h", 0.0, None)])
    assert impute_pmm(df.union(df), "rid", F.col("y"), "e", "t", ["g"], {}).count() == 4


def test_groups_beat_the_overall_mean(spark):
    rnd = random.Random(3)
    rows, hidden = [], {}
    for k in range(1500):
        g, h, x = rnd.choice("abc"), rnd.choice("uvw"), rnd.uniform(0, 10)
        y = {"a": 0, "b": 20, "c": 40}[g] + {"u": 0, "v": 5, "w": 9}[h] + 0.8 * x + rnd.gauss(0, 0.5)
        if k % 5 == 0:
            hidden[k] = y
        rows.append((k, f"e{k}", 0, g, h, x, None if k % 5 == 0 else y))
    got = run(table(spark, rows))
    error = sum(abs(got[k].value - y) for k, y in hidden.items()) / len(hidden)
    assert error < 1.5 and all(got[k].how == "similar" for k in hidden)


@pytest.mark.parametrize("cells,slots", [(1, 1), (7, 2)])
def test_small_grids(spark, cells, slots):
    rows = [(k, f"e{k}", 0, "a", "h", float(k), float(k) if k % 3 else None) for k in range(60)]
    got = run(table(spark, rows), cells=cells, slots=slots)
    assert all(r.value is not None for r in got.values())


def test_found_rows_come_from_filled_values(spark, data, monkeypatch):
    written = []
    monkeypatch.setattr(problems, "cut", lambda df: written.append(cut(df)) or written[-1])
    found = problems.p7_found(spark, data)
    assert len(written) == 1 and {"row_id", "field", "value", "filled", "donor_row_id", "how"} <= set(written[0].columns)
    assert found.count() == written[0].count() and written[0].where("filled and donor_row_id is not null").count() > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("cells,slots", [(2048, 16), (3, 4), (1, 1), (2, 500)])
def test_donors_are_the_nearest_of_all(spark, cells, slots):
    rnd = random.Random(7)
    # No groups or entity, one feature: predictions are linear in x. One extreme value, and half of all donors share one.
    donors = {k: 1e6 if k == 0 else 5.0 if k % 2 else rnd.uniform(0, 10) for k in range(400)}
    asking = {1000 + k: 5.0 if k % 5 == 0 else rnd.uniform(-1, 11) for k in range(150)}
    rows = [(k, None, 0, None, None, x, x) for k, x in donors.items()] + [(k, None, 0, None, None, x, None) for k, x in asking.items()]
    got = impute_pmm(table(spark, rows), "rid", F.col("y"), None, None, [], {"x": F.col("x")}, cells=cells, slots=slots, keep_observed=False).collect()
    assert {r.rid for r in got} == asking.keys()
    for r in got:
        x = asking[r.rid]
        farthest = sorted(abs(d - x) for d in donors.values())[min(slots, 400) - 1]
        assert r.how == "similar" and r.value == donors[r.donor_id] and abs(r.value - x) <= farthest + 1e-6
    if slots == 1:
        assert len({r.donor_id for r in got if asking[r.rid] == 5.0}) > 5


def test_masked_values_come_back(spark):
    """Observed values of the test table that are hidden and filled again: nearer than those of a random record of the same group."""
    listings = load(spark, "/root/testdata/sf0.01", "listings")
    hidden = F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(10)) == 0
    bedrooms = problems.observed_bedrooms()
    features = {"accommodates": F.col("accommodates"), "reviews": F.log1p("number_of_reviews")}
    groups = ["room_type", "neighbourhood_cleansed"]
    filled = impute_pmm(listings, "row_id", F.when(~hidden, bedrooms), None, None, groups, features, keep_observed=False)
    truth = listings.where(hidden).select("row_id", bedrooms.alias("y")).where("y is not null")
    both = filled.join(truth, "row_id")
    error, n, mean, true_mean = both.agg(F.avg(F.abs(F.col("value") - F.col("y"))), F.count("value"), F.avg("value"), F.avg("y")).first()
    known = listings.where(~hidden).select(*groups, bedrooms.alias("v")).where("v is not null")
    others = truth.join(listings.select("row_id", *groups), "row_id").join(known, groups).agg(F.avg(F.abs(F.col("v") - F.col("y")))).first()[0]
    assert n == truth.count() and error < 0.75 * others and abs(mean - true_mean) < 0.1


def test_two_fields_at_once_are_as_each_by_itself(spark):
    rnd = random.Random(11)
    rows = [(k, f"e{k % 150}", k % 5, rnd.choice(["a", "b", None]), rnd.choice("uv"), rnd.uniform(0, 9) if k % 7 else None, rnd.uniform(0, 5) if k % 4 else None) for k in range(400)]
    df = table(spark, rows).withColumn("q", F.when(F.col("rid") % 3 > 0, F.col("y") * 2 + F.coalesce("x", F.lit(1.0))))
    fields = {"y": (F.col("y"), {"x": F.col("x")}), "q": (F.col("q"), {"x": F.col("x"), "t": F.col("t")})}
    both = {(r.field, r.rid): r[2:] for r in impute_fields(df, "rid", fields, "e", "t", ["g", "h"], cells=3).collect()}
    for name, (target, features) in fields.items():
        alone = {r.rid: r[1:] for r in impute_pmm(df, "rid", target, "e", "t", ["g", "h"], features, cells=3).collect()}
        assert {k: v for (f, k), v in both.items() if f == name} == alone

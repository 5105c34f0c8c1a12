import math
import random

import pytest

from tidemark.llm.sketch import log_sketch, merge_sketches, sketch_percentiles

SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "day int, g string, v double, sign int, bucket string")


@pytest.mark.parametrize("error", [0.005, 0.02])
def test_every_percentile_is_within_the_error(spark, error):
    rnd = random.Random(8)
    rows = [(rnd.randrange(4), rnd.choice(["a", "b", None]), rnd.choice([0.0, rnd.gauss(0, 50), rnd.lognormvariate(0, 6), -rnd.lognormvariate(3, 2)])) for _ in range(6000)]
    sketch = merge_sketches(log_sketch(frame(spark, rows), ["day", "g"], "v", error), ["g"])
    for r in sketch_percentiles(sketch, ["g"], SHARES, error).collect():
        values = sorted(v for _, g, v in rows if g == r.g)
        assert r.n == len(values)
        for q in SHARES:
            exact = values[math.floor(q * (len(values) - 1))]
            assert r["p" + f"{q * 100:g}".replace(".", "_")] == pytest.approx(exact, rel=error * (1 + 1e-9), abs=1e-300)


def test_merging_equals_counting_at_once(spark):
    rows = [(k % 3, "a", float(k)) for k in range(500)]
    df = frame(spark, rows)
    merged = merge_sketches(log_sketch(df, ["day", "g"], "v"), ["g"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, log_sketch(df, ["g"], "v").collect()))


def test_odd_values(spark):
    rows = [(0, "a", v) for v in (None, float("nan"), float("inf"), float("-inf"), 5e-324, 1.7e308, -1.7e308, 0.0, -0.0)]
    got = sketch_percentiles(log_sketch(frame(spark, rows), ["g"], "v"), ["g"], (0.0, 0.5, 1.0)).first()
    assert got.n == 5 and got.p0 == pytest.approx(-1.7e308, rel=0.01) and got.p50 == 0 and got.p100 == pytest.approx(1.7e308, rel=0.01)
    assert log_sketch(frame(spark, []), ["g"], "v").count() == 0
    assert sketch_percentiles(log_sketch(frame(spark, []), [], "v"), [], (0.5,)).collect()[0].n is None
    assert [r.n for r in sketch_percentiles(log_sketch(frame(spark, [(0, "a", 2.0)] * 9), ["g"], "v"), ["g"], (0.5,)).collect()] == [9]

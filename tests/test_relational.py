import random

from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.numbers import amount
from tidemark.operators import relational as rel
from tidemark.operators.modelling import pick_best


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_keep_first_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "n"), (None, 4, "m"), ("a", 1, "y")], "k string, o int, v string")
    assert sorted(map(tuple, rel.dedupe_keep_first(df, ["k"], [F.col("o"), F.col("v")]).collect()), key=str) == [("a", 1, "y"), (None, 4, "m")]
    assert tuple(rel.duplicate_count(df, ["k"]).first()) == (5, 3, 60.0)
    assert rel.dedupe_keep_first(df.limit(0), ["k"], [F.col("o")]).count() == 0
    assert tuple(rel.duplicate_count(df.limit(0), ["k"]).first()) == (0, 0, None)


def test_null_profile(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "a string, b int")
    assert sorted(map(tuple, rel.null_profile(df, ["a", "b"]).collect())) == [("a", 1, 1, 50.0), ("b", 2, 0, 100.0)]


def test_lookup_falls_back_by_level(spark):
    source = spark.createDataFrame([("a", "x", 10.0), ("a", "x", 20.0), ("a", "y", 90.0), (None, "y", 1000.0)], "g string, h string, v double")
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "q"), (3, "b", "x"), (4, None, "y")], "id int, g string, h string")
    got = {r.id: r.p for r in rel.fill_by_lookup(df, source, [["g", "h"], ["g"]], "v", "p").collect()}
    assert got == {1: 15.0, 2: 20.0, 3: 55.0, 4: 55.0}


def test_reindex_leaves_out_missing_and_unlisted(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "k string, n int")
    assert [(r.k, r.position) for r in rel.ordered_reindex(df, "k", ["b", "missing", "a"]).orderBy("position").collect()] == [("b", 0), ("a", 2)]


def test_top_bottom_and_ties(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([5, 5, 3, 9, 1])], "k int, v double")
    got = sorted((r.side, r.place, r.k) for r in rel.top_bottom(df, "v", "k", 2).collect())
    assert got == [("bottom", 1, 4), ("bottom", 2, 2), ("top", 1, 3), ("top", 2, 0)]
    assert sorted((r.rank, r.k) for r in rel.rank_with_ties(df, "v", 2).collect()) == [(1, 3), (2, 0), (2, 1)]
    assert rel.best_of_group(df.withColumn("g", F.lit("x")), ["g"], "v", "k").first().k == 3


def test_previous_across_stretches(spark):
    rnd = random.Random(9)
    rows = [(k, rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, *(f"2024-01-{rnd.randrange(1, 9):02d} {rnd.randrange(24):02d}:00:00" for _ in range(9))])) for k in range(300)]
    rows = [r for r in rows if r[2]]
    df = spark.createDataFrame(rows, "k int, u string, t string").withColumn("t", F.to_timestamp("t"))
    got = {r.k: r.before for r in rel.with_previous(df, "u", "t", "k", F.col("k"), "before").collect()}
    want, last = {}, {}
    for k, u, t in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        want[k], last[u] = last.get(u), k
    assert got == want


def test_sample_is_exact_and_stable(spark):
    df = spark.range(1000).repartition(7)
    a = {r.id for r in rel.hash_sample(df, ["id"], 100).collect()}
    assert len(a) == 100 and a == {r.id for r in rel.hash_sample(spark.range(1000), ["id"], 100).collect()}
    assert rel.hash_sample(df, ["id"], 5000).count() == 1000
    assert 0.7 < rel.hash_split(df, ["id"], 0.8).where("is_train").count() / 1000 < 0.9


def test_grid_and_best_point(spark):
    df = spark.createDataFrame([(1200.0,)], "v double")
    grid = df.select(rel.value_grid(F.col("v") * 0.5, F.col("v") * 2, 50.0).alias("g")).first().g
    assert len(grid) == 37 and grid[0] == 600 and grid[-1] == 2400 and 1900 in grid
    best = spark.range(1).select(pick_best(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), F.array(F.lit(0.9), F.lit(0.5), F.lit(0.25))).alias("b")).first().b
    assert (best.price, best.expected) == (2.0, 1.0) or (best.price, best.expected) == (1.0, 0.9)
    assert best.price == 2.0


def test_observed_counts_need_no_pass(spark):
    df, seen = rel.counted(spark.range(50), "rows")
    df.collect()
    assert seen.get["row_count"] == 50


def test_stack_exclude_default(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2,)], "k int")
    assert sorted(map(tuple, rel.stacked([a, b]).collect())) == [(1, "x"), (2, None)]
    assert [r.k for r in rel.excluded_pairs(a.unionByName(b, True), b, ["k"]).collect()] == [1]
    assert a.select(rel.column_or(a, "absent", 7).alias("d")).first().d == 7
    z = rel.zscore(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double"), ["g"], "v", "z").collect()
    assert sorted((r.g, r.z and round(r.z, 4)) for r in z if r.g == "a") == [("a", -0.7071), ("a", 0.7071)] and [r.z for r in z if r.g == "b"] == [None]


def test_texts(spark):
    assert column(spark, ["follow-up needed", "ASAP", None], text.title_case) == ["Follow-Up Needed", "Asap", None]
    notes = ["ASAP. The nurse reviewed the blood pressure. The patient is in pain.", "No notes provided", "Follow-up needed.", "Routine review then Critical.", "Follow-up on Monday.", "Action: call family.", "ongoing assessment", "A stable bandage was used.", "pt in pain", "the PATIENT is Dizzy today", "Reviewed twice", "", None]
    assert column(spark, notes, text.note_urgency) == ["Asap", "None", "Follow-Up", "Review", "Follow-Up", "Action", "Ongoing Assessment", "None", "None", "None", "None", "None", "None"]
    assert column(spark, notes, text.note_status) == ["In Pain", *["Unknown"] * 8, "Dizzy", "Unknown", "Unknown", "Unknown"]
    assert column(spark, notes[:3], text.note_action) == ["reviewed the blood pressure", "Unknown", "Unknown"]
    assert column(spark, ["ASAP. The nurse Checked the left heel . The", "The nurse ran"], text.note_action) == ["checked the left heel", "Unknown"]
    assert column(spark, ["07 TO 09", "7", "a TO b", None], text.range_midpoint) == [8.0, None, None, None]
    got = column(spark, ["61 years 04 months", "95", "70 years", "soon", None], text.years_of)
    assert [g and round(g, 3) for g in got] == [61.333, 95.0, 70.0, 0.0, None]
    assert column(spark, ["Pool table", None, "x"], lambda c: text.contains_any_case(c, "POOL")) == [1, 0, 0]
    assert column(spark, ["\t a \n b  ", None], text.collapsed) == ["a b", None]
    assert column(spark, ["slide12.xml", "x", None], text.number_in) == [12, None, None]
    assert column(spark, ["a b  c", "", "   ", None], text.word_count) == [3, 0, 0, None]


def test_amounts(spark):
    given = ["R1,710.00", "$1,860", "R 1 160,00", "ZAR 1,662.21", " R580.31 ", "1036.35", "R 710,00", "$-1", "R2,980,000.00", "1.234,50", "n/a", "", None, "POA", "x" * 50_000]
    assert column(spark, given, amount) == [1710.0, 1860.0, 1160.0, 1662.21, 580.31, 1036.35, 710.0, -1.0, 2980000.0, 1234.5, None, None, None, None, None]


def test_dates(spark):
    df = spark.createDataFrame([("2026-08-09",), ("2024-02-29",)], "d string").select(F.to_date("d").alias("d"))
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in dates.calendar_parts(F.col("d")).items()]).collect()]
    assert got == [(2026, 8, 6, 1), (2024, 2, 3, 0)]
    assert [r.x for r in df.select(dates.since_flags(dates.year_month(F.col("d")), {"f": "2024-03"})["f"].alias("x")).collect()] == [1, 0]
    assert column(spark, ["2024-01-02 03:04:05", "2024/01/02 03:04", "January 2, 2024 8:29PM", "bad"], lambda c: dates.parse_first(c, ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "MMMM d, yyyy h:mma")).cast("string")) == ["2024-01-02 03:04:05", "2024-01-02 03:04:00", "2024-01-02 20:29:00", None]


def test_rows_without_time_are_kept(spark):
    rows = [(1, "a", None), (2, "a", "2024-01-01 10:00:00"), (3, "a", None), (4, "a", "2024-01-01 10:30:00"), (5, "a", "2024-01-03 10:00:00"), (6, None, None), (7, "a", "1969-12-31 23:00:00")]
    df = spark.createDataFrame(rows, "id int, k string, at string").withColumn("at", F.to_timestamp("at"))
    for typed in (df, df.withColumn("at", F.col("at").cast("timestamp_ntz"))):
        got = {r.id: r.before for r in rel.with_previous(typed, "k", "at", "id", F.col("id"), "before").collect()}
        assert got == {1: None, 2: 7, 3: None, 4: 2, 5: 4, 6: None, 7: None}

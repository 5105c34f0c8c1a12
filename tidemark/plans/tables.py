"""Queries of the relational operators: cleaning, filling, aligning, joining and picking. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.numbers import amount
from tidemark.operators import relational as rel
from tidemark.operators.modelling import pick_best
from tidemark.operators.statistics import percent_ranks as percent_rank_of
from tidemark.operators.statistics import two_level_mean
from tidemark.session import load

# Spellings, months and formats of the queries.
PRIORITIES = {"1-URGENT": "Urgent", "2-HIGH": "High", "5-LOW": "Low"}
REGIMES = {"since_1997": "1997-04", "since_1998": "1998-12", "since_1999": "1999-09", "since_2000": "2000-07"}
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "MM/dd/yyyy HH:mm", "MMMM d, yyyy h:mma")
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def dedupe_keep_first(spark, d):
    return rel.dedupe_keep_first(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in _LINE])


def duplicate_count(spark, d):
    return rel.duplicate_count(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def null_profile(spark, d):
    return rel.null_profile(load(spark, d, "visits"), ["visit_id", "nurse_id", "visit_start_time", "visit_end_time", "service_type", "nurse_notes"])


def distinct_sorted(spark, d):
    return load(spark, d, "part").select("p_brand").where("p_brand is not null").distinct().orderBy("p_brand")


def exact_replace(spark, d):
    return load(spark, d, "orders").select("o_orderkey", rel.replace_exact(F.col("o_orderpriority"), PRIORITIES).alias("priority"))


def parse_formats(spark, d):
    shapes = [F.date_format("o_orderdate", f) for f in FORMATS]
    key = F.pmod("o_orderkey", F.lit(4))
    spelt = F.when(key == 0, shapes[0]).when(key == 1, shapes[1]).when(key == 2, shapes[2]).otherwise(shapes[3])
    return load(spark, d, "orders").select("o_orderkey", spelt.alias("spelt")).select("o_orderkey", F.unix_seconds(dates.parse_first(F.col("spelt"), FORMATS)).alias("epoch"))


def coerce_numbers(spark, d):
    spelt = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.lit("n/a")).otherwise(F.col("o_orderkey").cast("string"))
    return load(spark, d, "orders").select("o_orderkey", spelt.try_cast("double").alias("number"))


def fill_constant(spark, d):
    return load(spark, d, "visits").select("row_id", F.coalesce("nurse_notes", F.lit("No notes provided")).alias("notes"))


def fill_column(spark, d):
    return load(spark, d, "visits").select("row_id", F.coalesce("visit_end_time", "visit_start_time").alias("known_time"))


def default_columns(spark, d):
    listings = load(spark, d, "listings")
    return listings.select("row_id", rel.column_or(listings, "number_of_reviews", 0).alias("reviews"), rel.column_or(listings, "instant_bookable", "f").alias("instant"))


def drop_incomplete(spark, d):
    return rel.drop_incomplete(load(spark, d, "listings").select("row_id", "neighbourhood_cleansed", "host_is_superhost", "price"))


def duration_minutes(spark, d):
    orders, lines = load(spark, d, "orders"), load(spark, d, "lineitem")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(dates.minutes_between(F.col("o_orderdate"), F.col("l_shipdate"))), 4).alias("mean_minutes"))


def row_audit(spark, d):
    """Rows before and after steps, by one pass."""
    per_key = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("large"))
    counts = per_key.agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("keep_first"), F.sum("large").alias("large"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("step"), F.col(c).alias("row_count")) for c in ("raw", "keep_first", "large")])))


def _gaps(spark, d):
    events = rel.with_previous(load(spark, d, "events"), "user_id", "ts", "event_id", F.col("ts"), "before")
    minutes = dates.minutes_between(F.col("before"), F.col("ts"))
    return events.select("event_id", "user_id", rel.mask_range(minutes, 0, 240).alias("gap"))


def gap_minutes(spark, d):
    return _gaps(spark, d).select("event_id", "user_id", F.round("gap", 6).alias("gap"))


def mean_gap_by_user(spark, d):
    means = _gaps(spark, d).where("user_id is not null").groupBy("user_id").agg(F.avg("gap").alias("mean_gap"), F.count("gap").alias("n"))
    return means.where("mean_gap is not null").select("user_id", F.round("mean_gap", 6).alias("mean_gap"), "n")


def top_bottom(spark, d):
    return rel.top_bottom(mean_gap_by_user(spark, d), "mean_gap", "user_id", 3)


def mean_of_means(spark, d):
    return two_level_mean(_gaps(spark, d), "user_id", F.col("gap")).select(F.round("mean_of_means", 6).alias("mean_of_means"), "groups")


def ordered_reindex(spark, d):
    counts = load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return rel.ordered_reindex(counts, "event_type", ["purchase", "view", "refund", "click", "error"]).orderBy("position")


def above_mean(spark, d):
    lines = load(spark, d, "lineitem")
    groups = lines.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"))
    overall = lines.agg(F.avg("l_quantity").alias("o"))
    return groups.crossJoin(F.broadcast(overall)).select("l_returnflag", F.round("m", 6).alias("mean_quantity"), (F.col("m") > F.col("o")).cast("int").alias("above"))


def inner_join_enrich(spark, d):
    nights, listings = load(spark, d, "calendar"), load(spark, d, "listings")
    newest = listings.where("id is not null").groupBy("id").agg(F.max_by(F.struct("room_type", "accommodates"), F.struct("last_scraped", "row_id")).alias("l")).select("id", "l.*")
    return nights.join(newest, nights.listing_id == newest.id).groupBy("room_type", "available").agg(F.count(F.lit(1)).alias("nights"), F.sum("accommodates").alias("places"))


def group_median_ratio(spark, d):
    priced = load(spark, d, "listings").select("row_id", "neighbourhood_cleansed", "room_type", "bedrooms", F.explode(F.array(amount(F.col("price")))).alias("amount")).where("amount > 0 and bedrooms is not null and not isnan(bedrooms)")
    joined = rel.with_group_median(priced, ["neighbourhood_cleansed", "room_type", "bedrooms"], "amount", "median_amount")
    usual = F.coalesce("median_amount", "amount")
    return joined.select("row_id", F.round(usual, 4).alias("median_amount"), F.round(F.try_divide(F.col("amount"), usual), 6).alias("ratio"))


def fallback_three_levels(spark, d):
    part, sold = load(spark, d, "part"), load(spark, d, "lineitem")
    source = sold.join(part, sold.l_partkey == part.p_partkey).select("p_brand", "p_type", "l_extendedprice")
    found = rel.fill_by_lookup(part.select("p_partkey", "p_brand", "p_type"), source, [["p_brand", "p_type"], ["p_brand"]], "l_extendedprice", "proxy")
    return found.select("p_partkey", F.round("proxy", 4).alias("proxy"))


def value_grid(spark, d):
    price = F.col("p_retailprice")
    return load(spark, d, "part").select("p_partkey", F.explode(rel.value_grid(price * 0.5, price * 2, 50.0)).alias("point")).select("p_partkey", F.round("point", 4).alias("point"))


def best_of_grid(spark, d):
    price = F.col("p_retailprice")
    part = load(spark, d, "part").select("p_partkey", price.alias("price"), rel.value_grid(price * 0.5, price * 2, 50.0).alias("grid"))
    chances = F.transform("grid", lambda p: 1 / (1 + F.exp(4 * (p / F.col("price") - 1))))
    best = pick_best(F.col("grid"), chances)
    return part.select("p_partkey", best.alias("b")).select("p_partkey", F.round("b.price", 4).alias("best"), F.round("b.expected", 4).alias("expected"))


def best_of_group(spark, d):
    return rel.best_of_group(load(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey")


def rank_with_ties(spark, d):
    return rel.rank_with_ties(load(spark, d, "part").select("p_partkey", "p_size"), "p_size", 20)


def zscore_by_group(spark, d):
    scored = rel.zscore(load(spark, d, "supplier"), ["s_nationkey"], "s_acctbal", "z")
    return scored.select("s_suppkey", F.round("z", 6).alias("z"))


def group_range_flags(spark, d):
    spread = F.max("s_acctbal") - F.min("s_acctbal")
    return load(spark, d, "supplier").groupBy("s_nationkey").agg(F.round(spread, 2).alias("spread"), (spread < 8000).alias("compressed"))


def group_shares(spark, d):
    counts = load(spark, d, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))


def conditional_rates(spark, d):
    bought = F.col("event_type") == "purchase"
    return load(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bought).alias("purchases"), F.round(F.count_if(bought) / F.count(F.lit(1)), 6).alias("rate"))


def best_and_worst(spark, d):
    means = load(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    best, worst = F.max_by("o_orderpriority", F.struct("mean", "o_orderpriority")), F.min_by("o_orderpriority", F.struct("mean", "o_orderpriority"))
    return means.groupBy("o_custkey").agg(best.alias("best"), worst.alias("worst"))


def pivot_counts(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.col("F").alias("finished"), F.col("O").alias("open"))


def grouping_sets(spark, d):
    return load(spark, d, "customer").groupingSets([["c_mktsegment"], ["c_nationkey"]], "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


def anti_join(spark, d):
    customers, orders = load(spark, d, "customer"), load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.excluded_pairs(customers.select("c_custkey", "c_mktsegment"), orders, ["c_custkey"])


def semi_join_order(spark, d):
    return load(spark, d, "supplier").join(load(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey", "s_name")


def calendar_features(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").distinct().select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in dates.calendar_parts(F.col("l_shipdate")).items()])


def regime_flags(spark, d):
    return load(spark, d, "orders").select("o_orderkey", dates.year_month(F.col("o_orderdate")).alias("month")).select("o_orderkey", *[c.alias(n) for n, c in dates.since_flags(F.col("month"), REGIMES).items()])


def time_index(spark, d):
    orders = load(spark, d, "orders")
    start = orders.agg(F.min(F.year("o_orderdate")).alias("first_year"))
    return orders.crossJoin(F.broadcast(start)).select("o_orderkey", ((F.year("o_orderdate") - F.col("first_year")) * 12 + F.month("o_orderdate")).alias("month_index"))


def chronological_split(spark, d):
    part = F.when(F.year("o_orderdate") <= 1998, "train").when(F.year("o_orderdate") == 1999, "validation").otherwise("test")
    return load(spark, d, "orders").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


def hash_sample(spark, d):
    return rel.hash_sample(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)


def hash_split(spark, d):
    return rel.hash_split(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.8)


def note_parts(spark, d):
    notes = load(spark, d, "visits").select("row_id", F.coalesce("nurse_notes", F.lit("No notes provided")).alias("note"))
    return notes.select("row_id", text.note_urgency(F.col("note")).alias("urgency"), text.note_status(F.col("note")).alias("status"), text.note_action(F.col("note")).alias("action"))


def amenity_flags(spark, d):
    return load(spark, d, "listings").select("row_id", *[text.contains_any_case(F.col("amenities"), t).alias(f"has_{t}") for t in ("pool", "wifi", "parking")])


def price_clean(spark, d):
    return load(spark, d, "listings").select("row_id", amount(F.col("price")).alias("amount"))


def range_midpoint(spark, d):
    spelt = F.format_string("%02d TO %02d", F.col("p_size"), F.col("p_size") + 2)
    return load(spark, d, "part").select("p_partkey", text.range_midpoint(F.when(F.pmod("p_partkey", F.lit(7)) == 0, F.lit("n/a")).otherwise(spelt)).alias("middle"))


def duration_years(spark, d):
    spelt = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.format_string("%d years %02d months", F.col("p_size"), F.pmod("p_partkey", F.lit(12)))).when(F.pmod("p_partkey", F.lit(3)) == 1, F.col("p_size").cast("string")).otherwise(F.lit("unknown"))
    return load(spark, d, "part").select("p_partkey", F.round(text.years_of(spelt), 6).alias("years"))


def natural_order(spark, d):
    return load(spark, d, "part").select("p_brand").distinct().select("p_brand", text.number_in(F.col("p_brand")).alias("number")).orderBy("number", "p_brand")


def collapsed_text(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", r"[ \t\r\n]+", " ").alias("collapsed"))


def cut_texts(spark, d):
    """Texts cut after the numbers of characters that reports of documents and of slides keep."""
    return load(spark, d, "documents").select("doc_id", F.substring("text", 1, 3500).alias("long_cut"), F.substring("text", 1, 2500).alias("short_cut"))


def slice_items(spark, d):
    items = F.split(F.regexp_replace("amenities", r'^\["|"\]$', ""), '", "')
    return load(spark, d, "listings").where("amenities like '[\"%'").select("row_id", F.array_join(F.slice(items, 1, 12), " | ").alias("first_items"))


def target_date_parts(spark, d):
    """The parts of one given day beside every row that is scored for it."""
    day = F.to_date(F.lit("2026-8-9"), "yyyy-M-d")
    return load(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in dates.calendar_parts(day).items()])


def half_even(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bround(F.avg("l_extendedprice"), 2).alias("mean_price"))


def finite_only(spark, d):
    """Values that are numbers and finite, of values some of which are made infinite, not a number or null."""
    part = F.pmod("event_id", F.lit(7))
    value = F.when(part == 0, F.lit(float("inf"))).when(part == 1, F.lit(float("nan"))).when(part == 2, F.lit(None)).otherwise(F.col("value"))
    return load(spark, d, "events").select("event_id", value.alias("value")).where(rel.is_finite(F.col("value")))


def parameter_grid(spark, d):
    """Every year with every pair of a growth and an elasticity: small tables of parameters, crossed."""
    years = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("demand"))
    growths, elasticities = spark.createDataFrame([(0.01,), (0.0315,)], "growth double"), spark.createDataFrame([(-0.1,), (-0.2,), (-0.3,), (-0.5,), (-1.0,)], "elasticity double")
    grid = years.crossJoin(F.broadcast(growths.crossJoin(elasticities)))
    return grid.select("year", "growth", "elasticity", F.round(F.col("demand") * (1 + F.col("growth") * F.col("elasticity")), 2).alias("demand"))


def series_by_year(spark, d):
    """Yearly series of several tables side by side, for the years that all of them have."""
    ordered = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    shipped = load(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("shipped"))
    priced = load(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_finished"))
    return ordered.join(shipped, "year").join(priced, "year")


def compounded_path(spark, d):
    """Level of a price that rises each year by the mean discount of that year, one year upon the other."""
    rates = load(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.avg("l_discount").alias("r"))
    level = F.exp(F.sum(F.log1p("r")).over(Window.orderBy("year")))
    return rates.select("year", F.round("r", 6).alias("rate"), F.round(level, 6).alias("level"))


def percent_ranks(spark, d):
    return percent_rank_of(load(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", F.round("percent_rank", 6).alias("percent_rank"))


def row_numbers(spark, d):
    return rel.with_position(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


def row_at_position(spark, d):
    return rel.with_position(load(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"]).where("position = 7").select("c_custkey", "c_name")


def prefix_strip(spark, d):
    return load(spark, d, "part").select("p_partkey", F.replace(F.concat(F.lit("num__"), F.col("p_name")), F.lit("num__"), F.lit("")).alias("name"))


def formatted(spark, d):
    """Numbers with separators and decimals, and days, as texts."""
    return load(spark, d, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.format_string("%s: %.1f", F.col("o_orderstatus"), F.round("o_totalprice", 1)).alias("line"))


def hash_sample_counts(spark, d):
    """How many rows the sample has, how many different ones, and how many of them are rows of the table."""
    sample = hash_sample(spark, d)
    real = sample.join(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different")).crossJoin(real.agg(F.count(F.lit(1)).alias("real")))


def hash_split_counts(spark, d):
    """Rows of both parts together, and whether the share of the first is within two in a hundred of what was asked."""
    return hash_split(spark, d).agg(F.count("is_train").alias("n"), (F.abs(F.count_if("is_train") / F.count(F.lit(1)) - 0.8) < 0.02).alias("near"))


def word_counts(spark, d):
    return load(spark, d, "visits").where("nurse_notes is not null").select("row_id", text.word_count(F.col("nurse_notes")).alias("n_words"), (text.word_count(F.col("nurse_notes")) >= 10).alias("is_long"))


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_keep_first, duplicate_count, null_profile, distinct_sorted, exact_replace, parse_formats, coerce_numbers, fill_constant, fill_column, default_columns, drop_incomplete, duration_minutes, row_audit,
        gap_minutes, mean_gap_by_user, top_bottom, mean_of_means, ordered_reindex, above_mean, inner_join_enrich, group_median_ratio, fallback_three_levels, value_grid, best_of_grid, best_of_group, rank_with_ties,
        zscore_by_group, group_range_flags, group_shares, conditional_rates, best_and_worst, pivot_counts, grouping_sets, anti_join, semi_join_order, calendar_features, regime_flags, time_index, chronological_split, hash_sample, hash_split, note_parts,
        amenity_flags, price_clean, range_midpoint, duration_years, natural_order, collapsed_text, cut_texts, slice_items, word_counts,
        target_date_parts, half_even, finite_only, parameter_grid, series_by_year, compounded_path, percent_ranks, row_numbers, row_at_position, prefix_strip, formatted, hash_sample_counts, hash_split_counts,
    )
}

_ORDER = ", ".join(_LINE)
_FIRST = f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS k FROM lineitem) WHERE k = 1"
_PARSED = r"""bare AS (SELECT *, regexp_replace(upper(price), '[\s\p{Z}]|ZAR|R|\$|€|£', '', 'g') AS b FROM listings),
    dotted AS (SELECT *, CASE WHEN regexp_matches(b, '^-?[0-9]+(\.[0-9]{3})*,[0-9]{1,2}$') THEN replace(replace(b, '.', ''), ',', '.') ELSE replace(b, ',', '') END AS d FROM bare),
    priced AS (SELECT *, CASE WHEN regexp_matches(d, '^-?[0-9]+(\.[0-9]+)?$') THEN CAST(d AS DOUBLE) END AS amount FROM dotted)"""
_GAPS = "gaps AS (SELECT event_id, user_id, CASE WHEN g BETWEEN 0 AND 240 THEN g END AS gap FROM (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 6e7 AS g FROM events))"
_MEANS = f"WITH {_GAPS}, means AS (SELECT user_id, round(avg(gap), 6) AS mean_gap, count(gap) AS n FROM gaps WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(gap) > 0)"
ORACLE = {
    "dedupe_keep_first": _FIRST,
    "duplicate_count": "SELECT count(*) AS row_count, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS surplus, round((count(*) - count(DISTINCT (l_orderkey, l_linenumber))) * 100.0::DOUBLE / count(*), 6) AS surplus_pct FROM lineitem",
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count({c}) AS non_nulls, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS null_pct FROM visits" for c in ("visit_id", "nurse_id", "visit_start_time", "visit_end_time", "service_type", "nurse_notes")),
    "distinct_sorted": "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY 1",
    "exact_replace": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '5-LOW' THEN 'Low' ELSE o_orderpriority END AS priority FROM orders",
    "parse_formats": "SELECT o_orderkey, CAST(epoch(date_trunc('minute', o_orderdate)) AS BIGINT) AS epoch FROM orders",
    "coerce_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS number FROM orders",
    "fill_constant": "SELECT row_id, coalesce(nurse_notes, 'No notes provided') AS notes FROM visits",
    "fill_column": "SELECT row_id, coalesce(visit_end_time, visit_start_time) AS known_time FROM visits",
    "default_columns": "SELECT row_id, coalesce(number_of_reviews, 0) AS reviews, 'f' AS instant FROM listings",
    "drop_incomplete": "SELECT row_id, neighbourhood_cleansed, host_is_superhost, price FROM listings WHERE neighbourhood_cleansed IS NOT NULL AND host_is_superhost IS NOT NULL AND price IS NOT NULL",
    "duration_minutes": "SELECT o_orderpriority, count(*) AS n, round(avg((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 6e7), 4) AS mean_minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "row_audit": "SELECT 'raw' AS step, count(*) AS row_count FROM lineitem UNION ALL SELECT 'keep_first', count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL SELECT 'large', count(*) FROM lineitem WHERE l_quantity > 25",
    "gap_minutes": f"WITH {_GAPS} SELECT event_id, user_id, round(gap, 6) AS gap FROM gaps",
    "mean_gap_by_user": f"{_MEANS} SELECT * FROM means",
    "top_bottom": f"{_MEANS}, ranked AS (SELECT *, row_number() OVER (ORDER BY mean_gap DESC, user_id) AS t, row_number() OVER (ORDER BY mean_gap, user_id) AS b FROM means) SELECT user_id, mean_gap, n, CAST(t AS INTEGER) AS place, 'top' AS side FROM ranked WHERE t <= 3 UNION ALL SELECT user_id, mean_gap, n, CAST(b AS INTEGER), 'bottom' FROM ranked WHERE b <= 3",
    "mean_of_means": f"WITH {_GAPS} SELECT round(avg(m), 6) AS mean_of_means, count(m) AS groups FROM (SELECT avg(gap) AS m FROM gaps WHERE user_id IS NOT NULL GROUP BY user_id)",
    "ordered_reindex": "SELECT event_type, CAST(CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'refund' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS INTEGER) AS position, count(*) AS n FROM events WHERE event_type IN ('purchase', 'view', 'refund', 'click', 'error') GROUP BY ALL ORDER BY 2",
    "above_mean": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_quantity, CAST(avg(l_quantity) > (SELECT avg(l_quantity) FROM lineitem) AS INTEGER) AS above FROM lineitem GROUP BY 1",
    "inner_join_enrich": "WITH newest AS (SELECT id, room_type, accommodates FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_scraped DESC, row_id DESC) AS k FROM listings WHERE id IS NOT NULL) WHERE k = 1) SELECT room_type, available, count(*) AS nights, CAST(sum(accommodates) AS BIGINT) AS places FROM calendar JOIN newest ON listing_id = id GROUP BY ALL",
    "group_median_ratio": f"WITH {_PARSED}, kept AS (SELECT * FROM priced WHERE amount > 0 AND bedrooms IS NOT NULL AND NOT isnan(bedrooms)), medians AS (SELECT neighbourhood_cleansed, room_type, bedrooms, median(amount) AS m FROM kept WHERE neighbourhood_cleansed IS NOT NULL AND room_type IS NOT NULL GROUP BY ALL) SELECT row_id, round(coalesce(m, amount), 4) AS median_amount, round(amount / coalesce(m, amount), 6) AS ratio FROM kept LEFT JOIN medians USING (neighbourhood_cleansed, room_type, bedrooms)",
    "fallback_three_levels": "WITH source AS (SELECT p_brand, p_type, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey), a AS (SELECT p_brand, p_type, median(l_extendedprice) AS m FROM source GROUP BY ALL), b AS (SELECT p_brand, median(l_extendedprice) AS m FROM source GROUP BY ALL) SELECT p_partkey, round(coalesce(a.m, b.m, (SELECT median(l_extendedprice) FROM source)), 4) AS proxy FROM part LEFT JOIN a USING (p_brand, p_type) LEFT JOIN b USING (p_brand)",
    "value_grid": "SELECT p_partkey, round(p_retailprice * 0.5::DOUBLE + k * 50.0::DOUBLE, 4) AS point FROM (SELECT p_partkey, p_retailprice, unnest(generate_series(0, CAST(floor(p_retailprice * 1.5::DOUBLE / 50.0::DOUBLE + 1e-9) AS BIGINT))) AS k FROM part)",
    "best_of_grid": "WITH grid AS (SELECT p_partkey, p_retailprice AS p, p_retailprice * 0.5::DOUBLE + k * 50.0::DOUBLE AS x FROM (SELECT p_partkey, p_retailprice, unnest(generate_series(0, CAST(floor(p_retailprice * 1.5::DOUBLE / 50.0::DOUBLE + 1e-9) AS BIGINT))) AS k FROM part)), scored AS (SELECT *, x / (1 + exp(4 * (x / p - 1))) AS e FROM grid), ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY e DESC, x) AS k FROM scored) SELECT p_partkey, round(x, 4) AS best, round(e, 4) AS expected FROM ranked WHERE k = 1",
    "best_of_group": "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1",
    "rank_with_ties": "SELECT * FROM (SELECT p_partkey, p_size, CAST(rank() OVER (ORDER BY p_size DESC) AS INTEGER) AS rank FROM part WHERE p_size IS NOT NULL) WHERE rank <= 20",
    "zscore_by_group": "SELECT s_suppkey, round(CASE WHEN stddev_samp(s_acctbal) OVER w > 0 THEN (s_acctbal - avg(s_acctbal) OVER w) / stddev_samp(s_acctbal) OVER w END, 6) AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)",
    "group_range_flags": "SELECT s_nationkey, round(max(s_acctbal) - min(s_acctbal), 2) AS spread, max(s_acctbal) - min(s_acctbal) < 8000 AS compressed FROM supplier GROUP BY 1",
    "group_shares": "SELECT o_orderstatus, CAST(year AS INTEGER) AS year, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM (SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL)",
    "conditional_rates": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS rate FROM events GROUP BY 1",
    "best_and_worst": "WITH m AS (SELECT o_custkey, o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY mean DESC, o_orderpriority DESC) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY mean, o_orderpriority) AS b FROM m) SELECT o_custkey, max(o_orderpriority) FILTER (a = 1) AS best, max(o_orderpriority) FILTER (b = 1) AS worst FROM r GROUP BY 1",
    "pivot_counts": "SELECT l_returnflag, nullif(count(*) FILTER (l_linestatus = 'F'), 0) AS finished, nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS open FROM lineitem GROUP BY 1",
    "grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey))",
    "anti_join": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "semi_join_order": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)",
    "calendar_features": "SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS weekday, CAST(isodow(l_shipdate) >= 6 AS INTEGER) AS is_weekend FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem)",
    "regime_flags": "SELECT o_orderkey, " + ", ".join(f"CAST(strftime(o_orderdate, '%Y-%m') >= '{v}' AS INTEGER) AS {k}" for k, v in REGIMES.items()) + " FROM orders",
    "time_index": "SELECT o_orderkey, CAST((year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders)) * 12 + month(o_orderdate) AS INTEGER) AS month_index FROM orders",
    "chronological_split": "SELECT CASE WHEN year(o_orderdate) <= 1998 THEN 'train' WHEN year(o_orderdate) = 1999 THEN 'validation' ELSE 'test' END AS part, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1",
    "note_parts": r"""WITH n AS (SELECT row_id, coalesce(nurse_notes, 'No notes provided') AS note FROM visits),
        found AS (SELECT row_id, note, lower(regexp_extract(note, '(?i)\b(asap|critical|urgent|action|review|monitoring|ongoing assessment|follow-up)\b', 1)) AS u, lower(regexp_extract(note, '(?i)the patient is (stable|in pain|dizzy|weak|restless|comfortable|improving)', 1)) AS s FROM n)
        SELECT row_id, CASE u WHEN '' THEN 'None' WHEN 'ongoing assessment' THEN 'Ongoing Assessment' WHEN 'follow-up' THEN 'Follow-Up' ELSE upper(u[1]) || u[2:] END AS urgency,
            CASE s WHEN '' THEN 'Unknown' WHEN 'in pain' THEN 'In Pain' ELSE upper(s[1]) || s[2:] END AS status,
            CASE WHEN regexp_matches(note, '(?i)The nurse (\w+) the ([^.]+)\.') THEN lower(regexp_extract(note, '(?i)The nurse (\w+) the ([^.]+)\.', 1)) || ' the ' || trim(regexp_extract(note, '(?i)The nurse (\w+) the ([^.]+)\.', 2), E' \t\r\n') ELSE 'Unknown' END AS action FROM found""",
    "amenity_flags": "SELECT row_id, " + ", ".join(f"CAST(coalesce(contains(lower(amenities), '{t}'), false) AS INTEGER) AS has_{t}" for t in ("pool", "wifi", "parking")) + " FROM listings",
    "price_clean": f"WITH {_PARSED} SELECT row_id, amount FROM priced",
    "range_midpoint": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size + 1.0::DOUBLE END AS middle FROM part",
    "duration_years": "SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_size + (p_partkey % 12) / 12.0::DOUBLE WHEN 1 THEN p_size ELSE 0 END, 6) AS years FROM part",
    "natural_order": "SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS number FROM part ORDER BY 2, 1",
    "collapsed_text": "SELECT doc_id, regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g') AS collapsed FROM documents WHERE text IS NOT NULL",
    "cut_texts": "SELECT doc_id, substring(text, 1, 3500) AS long_cut, substring(text, 1, 2500) AS short_cut FROM documents",
    "target_date_parts": "SELECT p_partkey, 2026 AS year, 8 AS month, 6 AS weekday, 1 AS is_weekend FROM part",
    "half_even": "SELECT l_suppkey, round_even(avg(l_extendedprice), 2) AS mean_price FROM lineitem GROUP BY 1",
    "finite_only": "SELECT event_id, value FROM events WHERE event_id % 7 > 2 AND value IS NOT NULL",
    "parameter_grid": "SELECT CAST(year AS INTEGER) AS year, growth::DOUBLE AS growth, elasticity::DOUBLE AS elasticity, round(demand * (1 + growth::DOUBLE * elasticity::DOUBLE), 2) AS demand FROM (SELECT year(o_orderdate) AS year, sum(o_totalprice) AS demand FROM orders GROUP BY 1), (VALUES (0.01), (0.0315)) g(growth), (VALUES (-0.1), (-0.2), (-0.3), (-0.5), (-1.0)) e(elasticity)",
    "series_by_year": "SELECT CAST(year AS INTEGER) AS year, orders, shipped, mean_finished FROM (SELECT year(o_orderdate) AS year, count(*) AS orders, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS mean_finished FROM orders GROUP BY 1) JOIN (SELECT year(l_shipdate) AS year, sum(l_quantity) AS shipped FROM lineitem GROUP BY 1) USING (year) WHERE mean_finished IS NOT NULL",
    "compounded_path": "WITH RECURSIVE r AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_discount) AS r FROM lineitem GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY year) AS k FROM r), p AS (SELECT k, year, r, 1 + r AS level FROM o WHERE k = 1 UNION ALL SELECT o.k, o.year, o.r, p.level * (1 + o.r) FROM o JOIN p ON o.k = p.k + 1) SELECT year, round(r, 6) AS rate, round(level, 6) AS level FROM p",
    "percent_ranks": "SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal), 6) AS percent_rank FROM supplier",
    "row_numbers": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders",
    "row_at_position": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 6",
    "prefix_strip": "SELECT p_partkey, p_name AS name FROM part",
    "formatted": "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus || ': ' || format('{:.1f}', round(o_totalprice, 1)) AS line FROM orders",
    "hash_sample_counts": "SELECT least(1000, count(*)) AS n, least(1000, count(*)) AS different, least(1000, count(*)) AS real FROM orders",
    "hash_split_counts": "SELECT count(*) AS n, true AS near FROM orders",
    "slice_items": """SELECT row_id, array_to_string(list_slice(string_split(regexp_replace(amenities, '^\\["|"\\]$', '', 'g'), '", "'), 1, 12), ' | ') AS first_items FROM listings WHERE amenities LIKE '["%'""",
    "word_counts": "SELECT row_id, CAST(n AS INTEGER) AS n_words, n >= 10 AS is_long FROM (SELECT row_id, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\\s+')) END AS n FROM (SELECT row_id, regexp_replace(nurse_notes, '^\\s+|\\s+$', '', 'g') AS t FROM visits WHERE nurse_notes IS NOT NULL))",
}

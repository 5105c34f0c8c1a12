"""Queries of the statistical operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.dates import calendar_parts
from tidemark.functions.numbers import amount
from tidemark.operators import fitting as fit
from tidemark.operators import modelling as ml
from tidemark.operators import statistics as st
from tidemark.operators.relational import stacked, with_group_median
from tidemark.session import cut, load, stored_once


def _rounded(df, places=6, keep=()):
    return df.select(*[F.round(c, places).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _monthly(spark, d):
    month = F.date_format("o_orderdate", "yyyy-MM")
    months = load(spark, d, "orders").groupBy(month.alias("month")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("price"), F.count_distinct("o_custkey").cast("double").alias("customers"))
    return months.withColumn("position", (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).cast("double"))


def describe_values(spark, d):
    both = stacked([load(spark, d, "events").select("value"), load(spark, d, "part").select("p_size")])
    return _rounded(st.describe(both, ["value", "p_size"]))


def group_mean_count_std(spark, d):
    return _rounded(load(spark, d, "events").where("event_type is not null").groupBy("event_type").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.stddev_samp("value").alias("std")))


def named_summary(spark, d):
    return _rounded(load(spark, d, "events").where("user_id is not null").groupBy("user_id").agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.count("event_id").alias("n_events")))


def quantiles_by_group(spark, d):
    return _rounded(st.exact_quantiles(load(spark, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}), 4)


def within_fences(spark, d):
    kept = st.within_fences(load(spark, d, "lineitem"), "l_extendedprice")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


def fences(spark, d):
    return _rounded(st.fences(load(spark, d, "lineitem"), "l_extendedprice"), 4)


def language_counts(spark, d):
    return st.value_counts(load(spark, d, "documents"), "lang")


def histogram_40(spark, d):
    return _rounded(st.histogram(load(spark, d, "events"), "value", 40))


def boxplot_by_type(spark, d):
    return _rounded(st.boxplot(load(spark, d, "events"), "event_type", "value"))


def kruskal_h(spark, d):
    return _rounded(st.kruskal(load(spark, d, "events"), "event_type", "value"))


def kruskal_p(spark, d):
    return _rounded(st.kruskal_decided(load(spark, d, "events"), "event_type", "value"))


def boxplot_fliers(spark, d):
    return st.fliers(load(spark, d, "events"), "event_type", "value").select("event_id", "event_type", "value")


def rank_auc(spark, d):
    return _rounded(st.rank_auc(load(spark, d, "listings"), F.when(F.col("host_is_superhost").isNotNull(), F.col("host_is_superhost") == "t"), F.col("number_of_reviews")))


def pearson_matrix(spark, d):
    return _rounded(st.pearson_matrix(_monthly(spark, d), ["orders", "price", "customers", "position"]))


def simple_regression(spark, d):
    return _rounded(st.simple_regression(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 4)


def paired_t(spark, d):
    order = Window.orderBy("position")
    months = _monthly(spark, d)
    growth = months.select(*[(F.col(c) / F.lag(c).over(order) - 1).alias(c) for c in ("orders", "price")])
    return _rounded(st.paired_t(growth, F.col("orders"), F.col("price")))


def pearson_p(spark, d):
    """Correlation of every pair of monthly series, with its two-sided p-value."""
    n = _monthly(spark, d).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = st.pearson_matrix(_monthly(spark, d), ["orders", "price", "customers", "position"]).crossJoin(F.broadcast(n))
    t = F.abs("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return _rounded(rows.select("left", "right", "r", (2 * st.t_p(t, F.col("n") - 2)).alias("p")))


def regression_p(spark, d):
    """The line through monthly counts of orders over time, with the p-value of its slope."""
    fit = st.simple_regression(_monthly(spark, d), "position", "orders")
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))
    return _rounded(fit.select("slope", "intercept", "r2", "n", (2 * st.t_p(t, F.col("n") - 2)).alias("p")))


def paired_t_p(spark, d):
    """Whether the yearly growth of orders is greater than that of their mean price: t and its upper tail."""
    order = Window.orderBy("year")
    years = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("price"))
    growth = years.select(*[(F.col(c) / F.lag(c).over(order) - 1).alias(c) for c in ("orders", "price")])
    tested = st.paired_t(growth, F.col("orders"), F.col("price"))
    return _rounded(tested.withColumn("p", st.t_p(F.col("t"), F.col("n") - 1)))


def growth_rates(spark, d):
    order = Window.orderBy("year")
    years = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    rate = F.col("n") / F.lag("n").over(order) - 1
    level = F.col("n") / F.first("n").over(order)
    return years.select("year", "n", F.round(rate, 6).alias("growth"), F.round(level, 6).alias("level"))


def trend_forecast(spark, d):
    months = _monthly(spark, d).select("position", "orders")
    ahead = months.agg(F.max("position").alias("m")).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.col("m") + k)).alias("position"))
    return _rounded(st.trend_forecast(months, "position", "orders", ahead), 4)


def regression_metrics(spark, d):
    lines = load(spark, d, "lineitem")
    naive = lines.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("unit"))
    scored = lines.crossJoin(F.broadcast(naive))
    return _rounded(st.regression_metrics(scored, F.col("l_extendedprice"), F.col("l_quantity") * F.col("unit")), 4)


def alert_metrics(spark, d):
    events = load(spark, d, "events")
    return _rounded(st.classification_metrics(events, F.col("event_type") == "error", F.col("value") > 20))


def tails(spark, d):
    limits = st.exact_quantiles(load(spark, d, "customer"), [], F.col("c_acctbal"), {"low": 0.05, "high": 0.95})
    tail = F.when(F.col("c_acctbal") <= F.col("low"), "low").when(F.col("c_acctbal") >= F.col("high"), "high")
    return load(spark, d, "customer").crossJoin(F.broadcast(limits)).select("c_custkey", tail.alias("tail")).where("tail is not null")


def impute_scale(spark, d):
    customers = load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return _rounded(ml.impute_and_scale(customers, ["c_acctbal"]))


def fill_mode(spark, d):
    return ml.fill_with_mode(load(spark, d, "listings").select("row_id", "host_is_superhost"), "host_is_superhost")


def one_hot(spark, d):
    return ml.one_hot_drop_first(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


def class_weights(spark, d):
    return _rounded(ml.balanced_weights(load(spark, d, "lineitem").select("l_returnflag"), "l_returnflag").distinct())


def expanding_folds(spark, d):
    orders = load(spark, d, "orders").select("o_orderdate", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return stacked([pair.agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).select(F.lit(k).alias("fold"), F.lit(side).alias("side"), "*") for k, fold in enumerate(ml.expanding_folds(orders, "at", 5), 1) for side, pair in zip(("train", "validate"), fold, strict=True)])


def _model_rows(spark, d):
    """Scrapes of listings with the amount asked for a night, within its fences."""
    columns = ["room_type", "neighbourhood_cleansed", F.unix_seconds(F.col("last_scraped").cast("timestamp")).alias("at"), F.explode(F.array(amount(F.col("price")))).alias("amount")]
    numbers = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("accommodates", "bedrooms", "number_of_reviews", "minimum_nights", "review_scores_rating")]
    rows = load(spark, d, "listings").select(*columns, *numbers).where("amount > 0 and at is not null")
    rows = ml.with_log_target(st.within_fences(rows, "amount"), "amount").withColumn("year", F.col("at") / 31_557_600.0 - 50)
    return rows


_NUMBERS = ("accommodates", "bedrooms", "number_of_reviews", "minimum_nights", "review_scores_rating", "year")
_CATEGORIES = ("room_type", "neighbourhood_cleansed")
_tables: dict[tuple, tuple] = {}


def _model_table(spark, d):
    """The rows written once in a session as a table for fitting: its folder, the numbers of categories, the names of the inputs and
    the number of training rows, those of the first four fifths of time."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _tables:
        rows = cut(_model_rows(spark, d))
        split = st.exact_quantiles(rows, [], F.col("at"), {"s": 0.8}).first()["s"] or 0.0
        coded, labels = ml.coded(rows, _CATEGORIES)
        inputs = [F.col(c).cast("double").alias(f"n{k}") for k, c in enumerate(_NUMBERS)] + [F.col(f"{c}__i").alias(f"c{k}") for k, c in enumerate(_CATEGORIES)]
        kept = coded.select("at", "amount", F.col("log_target").alias("y"), *inputs)
        train = ml.time_blocks(ml.time_blocks(kept.where(F.col("at") <= split), "at", 5), "at", 4, "part")
        test = kept.where(F.col("at") > split).withColumns({"block": F.lit(-1), "part": F.lit(-1)})
        path = stored_once(spark, ("model rows", d), lambda to: train.unionByName(test).write.parquet(to))
        n = spark.read.parquet(path).where("part >= 0").count()
        _tables[key] = path, [len(v) for v in labels], [*_NUMBERS, *[f"{c}__v_{v}" for c, of in zip(_CATEGORIES, labels, strict=True) for v in of]], n
    return _tables[key]


def _scores(spark, d):
    """Scores of the whole grid, searched and written when a query of the session first asks for them."""
    path, kinds, *_ = _model_table(spark, d)
    return spark.read.parquet(stored_once(spark, ("grid scores", d), lambda to: fit.search(spark, path, kinds).write.parquet(to)))


def _tuned_and_stacked(spark, d):
    """The test rows as the six models with their best settings and the stack predict them, written when a query of the session
    first asks for them."""
    path, kinds, _, n = _model_table(spark, d)
    names = {(m, fit.named(s)): s for m, of in fit.SETTINGS.items() for s in of}
    tuned = lambda: {r["model"]: names[r["model"], r["params"]] for r in ml.best_params(_scores(spark, d)).collect()}
    return spark.read.parquet(stored_once(spark, ("stacked", d), lambda to: fit.stacked(spark, path, kinds, tuned(), 5, 1.0 / max(n, 1)).write.parquet(to)))


def forecast_leaderboard(spark, d):
    """The six models with their best settings and the stack of three of them, on the rows of the last fifth of time."""
    rows = _tuned_and_stacked(spark, d)
    scored = [st.regression_metrics(rows.where(F.col("model") == name), F.col("amount"), F.col("predicted")).select(F.lit(name).alias("model"), "rmse", "mae", "r2") for name in (*fit.SETTINGS, "stacking")]
    return stacked(scored).orderBy("rmse", "model")


def stacking_forecast(spark, d):
    return st.regression_metrics(_tuned_and_stacked(spark, d).where("model = 'stacking'"), F.col("amount"), F.col("predicted"))


def fold_scores(spark, d):
    return _scores(spark, d)


def best_params(spark, d):
    return ml.best_params(_scores(spark, d))


def feature_importance(spark, d):
    path, kinds, names, _ = _model_table(spark, d)
    named = spark.createDataFrame([(k, n.removeprefix("neighbourhood_cleansed__v_")) for k, n in enumerate(names)], "input int, feature string")
    return fit.forest_importances(spark, path, kinds, 100, 20).join(F.broadcast(named), "input").select("feature", "importance").orderBy(F.desc("importance"), "feature").limit(15)


def _nights(spark, d):
    """Nights of the calendar with their listing: what is known of a booking before it is made, and label (1 where booked)."""
    listings = load(spark, d, "listings").where("id is not null").groupBy("id").agg(F.max_by(F.struct("room_type", "neighbourhood_cleansed", "accommodates", "number_of_reviews", "minimum_nights", "price"), F.struct("last_scraped", "row_id")).alias("l")).select("id", "l.*")
    priced = listings.select("*", F.explode(F.array(amount(F.col("price")))).alias("base")).where("base > 0").drop("price")
    # Nights, their weights and the curves all read the listings.
    priced = cut(with_group_median(priced, ["neighbourhood_cleansed", "room_type"], "base", "median").withColumn("usual", F.coalesce("median", "base")).drop("median"))
    nights = load(spark, d, "calendar").select("listing_id", F.coalesce(F.try_to_date("calendar_date", "yyyy-MM-dd"), F.try_to_date("calendar_date", "dd/MM/yyyy")).alias("night"), (F.col("available") == "f").cast("double").alias("label")).where("night is not null and label is not null")
    rows = nights.join(priced, nights.listing_id == priced.id).drop("listing_id")
    return rows.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x_{c}") for c in ("accommodates", "number_of_reviews", "minimum_nights")], (F.col("base") / F.col("usual")).alias("price_ratio"), *[c.cast("double").alias(f"x_{n}") for n, c in calendar_parts(F.col("night")).items() if n != "year"]), priced


_BOOKING = ["price_ratio", "x_accommodates", "x_number_of_reviews", "x_minimum_nights", "x_month", "x_weekday", "x_is_weekend"]


_fitted: dict[tuple, tuple] = {}


def _booking(spark, d):
    """The classifier of bookings, fitted once in a session, its rows and the listings with their prices; every fifth listing is held out."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _fitted:
        rows, priced = _nights(spark, d)
        weighted = cut(ml.balanced_weights(rows, "label"))
        coded, labels = ml.coded(weighted, ["room_type"])
        held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
        kinds = [len(v) for v in labels]
        train = stored_once(spark, ("booking rows", d), lambda to: coded.where(~held).select(F.col("label").alias("y"), "weight", *_booking_inputs()).write.parquet(to))
        forest = stored_once(spark, ("booking forest", d), lambda to: fit.grow_forest(spark, train, kinds, 100, 30).write.parquet(to))
        _fitted[key] = forest, labels, coded.where(held), priced
    return _fitted[key]


def _booking_inputs(of=_BOOKING):
    return [F.col(c).cast("double").alias(f"n{k}") for k, c in enumerate(_BOOKING) if c in of] + [F.col("room_type__i").alias("c0")]


def _chance(rows, forest, labels, out):
    return fit.forest_chance(rows, forest, [len(v) for v in labels], 30, out)


def booking_model(spark, d):
    forest, labels, held, _ = _booking(spark, d)
    return st.rank_auc(_chance(held.select("label", *_booking_inputs()), forest, labels, "p1"), F.col("label"), F.round("p1", 9))


def _priced(spark, d):
    """The listings (id, base, usual) with their chances of a booking on one given day by bins of the price ratio, and the limits of these bins."""
    forest, labels, _, priced = _booking(spark, d)
    day = F.to_date(F.lit("2026-12-24"))
    rows = priced.select("id", "room_type", "base", "usual", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x_{c}") for c in ("accommodates", "number_of_reviews", "minimum_nights")], *[c.cast("double").alias(f"x_{n}") for n, c in calendar_parts(day).items() if n != "year"])
    coded, _ = ml.coded(ml.with_prices(rows, "base", "usual"), ["room_type"], labels)
    inputs = coded.select("id", "base", "usual", *_booking_inputs(coded.columns))
    return fit.with_chances(inputs, forest, [len(v) for v in labels], 30, "chances"), fit.forest_edges(spark.read.parquet(forest))[0]


def revenue_curve(spark, d):
    """Of every listing and price of its grid the chance of a booking on one given day, by the classifier, and the revenue expected."""
    rows, limits = _priced(spark, d)
    scored = ml.price_curve(rows, "base", "usual").select("id", "base", "price", F.element_at("chances", fit.bin_of(F.col("price_ratio"), limits) + 1).alias("chance"))
    return scored.select("*", (F.col("price") * F.col("chance")).alias("revenue"))


def optimal_prices(spark, d):
    """Of every listing the price with the highest revenue expected on that day."""
    return fit.best_of_grids(*_priced(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        describe_values, group_mean_count_std, named_summary, quantiles_by_group, within_fences, fences, language_counts, histogram_40, boxplot_by_type, kruskal_h, kruskal_p, rank_auc, pearson_matrix, simple_regression,
        paired_t, growth_rates, trend_forecast, regression_metrics, alert_metrics, tails, impute_scale, fill_mode, one_hot, class_weights, expanding_folds, forecast_leaderboard, stacking_forecast, fold_scores, best_params, feature_importance, booking_model,
        boxplot_fliers, pearson_p, regression_p, paired_t_p, revenue_curve, optimal_prices,
    )
}

_DESCRIBE = "SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max, round(skewness({c}), 6) AS skew FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {t})"
_MONTHS = "months AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS orders, avg(o_totalprice) AS price, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS customers, CAST(max(year(o_orderdate) * 12 + month(o_orderdate)) AS DOUBLE) AS position FROM orders GROUP BY 1)"
_FENCE = "f AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)"
#: Upper tail of t with v degrees of freedom, by Simpson's rule over 20,000 steps i.
_TAIL = "(0.5 - t / 20000 / 3 * sum((CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((v + 1) / 2.0::DOUBLE) - lgamma(v / 2.0::DOUBLE) - 0.5 * ln(v * pi()) - (v + 1) / 2.0::DOUBLE * ln(1 + pow(t * i / 20000, 2) / v))))"
ORACLE = {
    "describe_values": _DESCRIBE.format(c="value", t="events") + " UNION ALL " + _DESCRIBE.format(c="p_size", t="part"),
    "group_mean_count_std": "SELECT event_type, round(avg(value), 6) AS mean, count(value) AS n, round(stddev_samp(value), 6) AS std FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "named_summary": "SELECT user_id, round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value, count(event_id) AS n_events FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "quantiles_by_group": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1",
    "within_fences": f"WITH {_FENCE} SELECT count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem, f WHERE l_extendedprice BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)",
    "fences": f"WITH {_FENCE} SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5::DOUBLE * (q3 - q1), 4) AS low, round(q3 + 1.5::DOUBLE * (q3 - q1), 4) AS high FROM f",
    "language_counts": "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "histogram_40": "WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events), p AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 40)) + 1, 40) AS INTEGER) AS bin, lo, (hi - lo) / 40 AS w FROM events, s WHERE value IS NOT NULL) SELECT bin, round(lo + (bin - 1) * w, 6) AS low, round(lo + bin * w, 6) AS high, count(*) AS n FROM p GROUP BY ALL",
    "boxplot_by_type": "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), j AS (SELECT *, value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM events JOIN q USING (event_type)) SELECT event_type, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(value) FILTER (ok), 6) AS whisker_low, round(max(value) FILTER (ok), 6) AS whisker_high, count(*) FILTER (NOT ok) AS fliers FROM j WHERE value IS NOT NULL GROUP BY 1",
    "kruskal_h": "WITH r AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS rk FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL), g AS (SELECT sum(rk) AS s, count(*) AS m FROM r GROUP BY event_type), t AS (SELECT sum(pow(CAST(k AS DOUBLE), 3) - k) AS t FROM (SELECT count(*) AS k FROM r GROUP BY value)), a AS (SELECT sum(s * s / m) AS s, count(*) AS groups, CAST(sum(m) AS BIGINT) AS n FROM g) SELECT round((12.0::DOUBLE / (CAST(n AS DOUBLE) * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (pow(CAST(n AS DOUBLE), 3) - n)), 6) AS h, groups, n FROM a, t",
    "rank_auc": "WITH r AS (SELECT CAST(host_is_superhost = 't' AS INTEGER) AS y, rank() OVER (ORDER BY number_of_reviews) + (count(*) OVER (PARTITION BY number_of_reviews) - 1) / 2.0::DOUBLE AS rk FROM listings WHERE host_is_superhost IS NOT NULL AND number_of_reviews IS NOT NULL), a AS (SELECT sum(rk) FILTER (y = 1) AS s, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS q FROM r) SELECT round((s - CAST(p AS DOUBLE) * (p + 1) / 2) / (CAST(p AS DOUBLE) * q), 6) AS auc, p AS positives, q AS negatives FROM a",
    "pearson_matrix": f"WITH {_MONTHS} " + " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 6) AS r FROM months" for k, a in enumerate(("orders", "price", "customers", "position")) for b in ("orders", "price", "customers", "position")[k + 1 :]),
    "simple_regression": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem",
    "paired_t": f"WITH {_MONTHS}, g AS (SELECT (orders / lag(orders) OVER (ORDER BY position) - 1) - (price / lag(price) OVER (ORDER BY position) - 1) AS d FROM months) SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t, count(d) AS n FROM g",
    "growth_rates": "WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1) SELECT year, n, round(n / lag(n) OVER (ORDER BY year) - 1, 6) AS growth, round(n / first_value(n) OVER (ORDER BY year), 6) AS level FROM y",
    "trend_forecast": f"WITH {_MONTHS}, f AS (SELECT regr_slope(orders, position) AS s, regr_intercept(orders, position) AS i, regr_count(orders, position) AS n, regr_sxx(orders, position) AS xx, regr_syy(orders, position) AS yy, regr_sxy(orders, position) AS xy, regr_avgx(orders, position) AS mx, max(position) AS m FROM months), p AS (SELECT *, m + unnest(generate_series(1, 12)) AS position FROM f), w AS (SELECT position, i + s * position AS y, 1.96::DOUBLE * sqrt((yy - xy * xy / xx) / (n - 2)) * sqrt(1 + 1.0::DOUBLE / n + pow(position - mx, 2) / xx) AS w FROM p) SELECT round(position, 4) AS position, round(y, 4) AS forecast, round(y - w, 4) AS low, round(y + w, 4) AS high FROM w",
    "regression_metrics": "WITH u AS (SELECT sum(l_extendedprice) / sum(l_quantity) AS u FROM lineitem), e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * u AS e FROM lineitem, u) SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(y)), 4) AS r2, count(e) AS n FROM e",
    "alert_metrics": "WITH c AS (SELECT count(*) FILTER (event_type = 'error' AND value > 20) AS tp, count(*) FILTER (event_type <> 'error' AND value > 20) AS fp, count(*) FILTER (event_type = 'error' AND NOT value > 20) AS fn, count(*) FILTER (event_type <> 'error' AND NOT value > 20) AS tn FROM events) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS false_positive_rate FROM c",
    "tails": "WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer) SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'low' ELSE 'high' END AS tail FROM customer, q WHERE c_acctbal <= a OR c_acctbal >= b",
    "impute_scale": "WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS x FROM customer), f AS (SELECT c_custkey, coalesce(x, (SELECT median(x) FROM v)) AS x FROM v) SELECT c_custkey, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS c_acctbal FROM f",
    "fill_mode": "SELECT row_id, coalesce(host_is_superhost, (SELECT host_is_superhost FROM listings WHERE host_is_superhost IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS host_is_superhost FROM listings",
    "one_hot": 'SELECT c_custkey, c_mktsegment, CAST(c_mktsegment = \'BUILDING\' AS INTEGER) AS "c_mktsegment_BUILDING", CAST(c_mktsegment = \'FURNITURE\' AS INTEGER) AS "c_mktsegment_FURNITURE", CAST(c_mktsegment = \'HOUSEHOLD\' AS INTEGER) AS "c_mktsegment_HOUSEHOLD", CAST(c_mktsegment = \'MACHINERY\' AS INTEGER) AS "c_mktsegment_MACHINERY" FROM customer',
    "class_weights": "SELECT l_returnflag, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM lineitem GROUP BY 1",
    "kruskal_p": "WITH " + st.KRUSKAL_SQL.format(key="event_type", value="value", table="events") + " SELECT round(h, 6) AS h, groups, n, round(p, 6) AS p, p < 0.05 AS differs FROM tested",
    "boxplot_fliers": "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value NOT BETWEEN a - 1.5::DOUBLE * (b - a) AND b + 1.5::DOUBLE * (b - a)",
    "pearson_p": f"WITH {_MONTHS}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, corr({a}, {b}) AS r, count(*) - 2 AS v FROM months" for k, a in enumerate(("orders", "price", "customers", "position")) for b in ("orders", "price", "customers", "position")[k + 1 :]) + f"), x AS (SELECT *, abs(r) * sqrt(v / (1 - r * r)) AS t FROM c) SELECT x.left, x.right, round(r, 6) AS r, abs(round(2 * {_TAIL}, 6)) AS p FROM x, generate_series(0, 20000) s(i) GROUP BY x.left, x.right, r, v, t",
    "regression_p": f"WITH {_MONTHS}, c AS (SELECT regr_slope(orders, position) AS slope, regr_intercept(orders, position) AS intercept, regr_r2(orders, position) AS r2, CAST(count(*) AS BIGINT) AS n FROM months), x AS (SELECT *, n - 2 AS v, sqrt(r2 * (n - 2) / (1 - r2)) AS t FROM c) SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, n, round(2 * {_TAIL}, 6) AS p FROM x, generate_series(0, 20000) s(i) GROUP BY slope, intercept, r2, n, v, t",
    "paired_t_p": f"WITH y AS (SELECT year(o_orderdate) AS year, CAST(count(*) AS DOUBLE) AS orders, avg(o_totalprice) AS price FROM orders GROUP BY 1), g AS (SELECT (orders / lag(orders) OVER (ORDER BY year) - 1) - (price / lag(price) OVER (ORDER BY year) - 1) AS d FROM y), x AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, count(d) AS n, count(d) - 1 AS v FROM g) SELECT round(t, 6) AS t, n, round({_TAIL}, 6) AS p FROM x, generate_series(0, 20000) s(i) GROUP BY t, n, v",
    "expanding_folds": "WITH o AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders), q AS (SELECT quantile_cont(s, 1 / 6.0::DOUBLE) AS a, quantile_cont(s, 2 / 6.0::DOUBLE) AS b, quantile_cont(s, 3 / 6.0::DOUBLE) AS c, quantile_cont(s, 4 / 6.0::DOUBLE) AS d, quantile_cont(s, 5 / 6.0::DOUBLE) AS e FROM o), p AS (SELECT s, CAST(s > a AS INTEGER) + CAST(s > b AS INTEGER) + CAST(s > c AS INTEGER) + CAST(s > d AS INTEGER) + CAST(s > e AS INTEGER) AS block FROM o, q) SELECT CAST(k AS INTEGER) AS fold, CASE WHEN block < k THEN 'train' ELSE 'validate' END AS side, count(*) AS n, min(s) AS first_at, max(s) AS last_at FROM p, generate_series(1, 5) f(k) WHERE block <= k GROUP BY ALL",
}

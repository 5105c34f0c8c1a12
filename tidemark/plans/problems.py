"""The pN queries of the general problems: sessions, intervals, instants and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.imputation import impute_fields
from tidemark.operators.intervals import periods_and_gaps
from tidemark.operators.sessions import sessionize
from tidemark.plans.visits import instants, merged_visits
from tidemark.session import cut, load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every nurse: a visit starting more than 120 minutes after the previous start opens one."""
    sessions = sessionize(merged_visits(spark, sf_dir), "nurse_id", "start_ms", 120 * 60_000)
    return sessions.select("nurse_id", "start_ms", "end_ms", F.col("event_count").alias("visit_count"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of every nurse at work, and the gaps of at most 12 hours between them."""
    return periods_and_gaps(merged_visits(spark, sf_dir), "nurse_id", "start_ms", "end_ms", 12 * 3_600_000)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time of visits that names an instant, as UTC milliseconds."""
    return instants(spark, sf_dir)


def observed_rating(column: str = "review_scores_rating"):
    """The rating on the scale of 1 to 5, one on the old scale of 20 to 100 divided by 20; null where it is missing."""
    v = F.col(column)
    return F.when(F.isnan(v), None).when(v.between(1, 5), v).when(v.between(20, 100), v / 20)


def observed_bedrooms(column: str = "bedrooms"):
    """The count of bedrooms; null where it is missing."""
    v = F.col(column)
    return F.when(F.isnan(v), None).when(v.between(0, 20) & (v == F.floor(v)), v)


def p7_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing rating and bedroom count of listings, with the value copied into it, its donor and how it was found."""
    rating, bedrooms = observed_rating(), observed_bedrooms()
    common = {"accommodates": F.col("accommodates"), "reviews": F.log1p("number_of_reviews"), "nights": F.log1p("minimum_nights"), "superhost": (F.col("host_is_superhost") == "t").cast("int")}
    fields = {"review_scores_rating": (rating, common | {"bedrooms": bedrooms, "no_bedrooms": bedrooms.isNull().cast("int")}), "bedrooms": (bedrooms, common | {"rating": rating, "no_rating": rating.isNull().cast("int")})}
    filled = impute_fields(load(spark, sf_dir, "listings"), "row_id", fields, "id", "last_scraped", ["room_type", "neighbourhood_cleansed"], keep_observed=False)
    return filled.withColumnRenamed("donor_id", "donor_row_id")


def p7_same_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The missing values that were filled from the latest row of the same listing, and how many of each field were filled otherwise."""
    filled = cut(p7_filled(spark, sf_dir))
    own = filled.where("how = 'same_entity'").select("field", "row_id", "donor_row_id", "value")
    others = filled.where("how is distinct from 'same_entity'").groupBy("field").agg(F.count(F.lit(1)).alias("row_id"))
    return own.unionAll(others.select("field", "row_id", F.lit(None).cast("bigint"), F.lit(None).cast("double")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The missing values: all that the imputation had to fill, whether a donor was found or not.

    The filled table is written first; selected from directly, its values would not be computed at all.
    """
    return cut(p7_filled(spark, sf_dir)).select("row_id", "field")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p7_found": p7_found, "p7_filled": p7_filled, "p7_same_listing": p7_same_listing}

_UNORDERED = ", ".join(f"'{f}'" for f in (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S.%g", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S.%g", "%Y-%m-%dT%H:%M:%S.%f", "%Y/%m/%d %H:%M", "%B %d, %Y %I:%M%p",
    "%Y%m%dT%H%M%S", "%a, %d %b %Y %H:%M:%S", "%a, %d %B %Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d %b %Y %H:%M", "%d %B %Y %H:%M",
))
_ORDERED = lambda first: ", ".join(f"'{f}'" for f in (f"{first}/%Y %H:%M", f"{first}/%Y %I:%M %p", f"{first.replace('/', '-')}-%Y %I:%M:%S %p"))
_SHIFTS = "MAP {'UTC': 0, 'GMT': 0, 'SGT': 480, 'BST': 60, 'CET': 60, 'CEST': 120, 'AEST': 600, 'AEDT': 660, 'EST': -300, 'EDT': -240, 'SAST': 120}"
#: The instants in SQL: zone and rest of the text taken apart, the rest parsed by formats, the later of two instants corrected.
INSTANTS = rf"""
    texts AS (SELECT row_id, feed_id, 'visit_start_time' AS field, trim(visit_start_time) AS x FROM visits UNION ALL SELECT row_id, feed_id, 'visit_end_time', trim(visit_end_time) FROM visits),
    apart AS (SELECT row_id, field, x, tz_name, date_order, regexp_extract(x, ':\d{{2}}(?:\.\d+)?\s*(?:GMT|UTC)?\s*([+-]\d{{2}}:?\d{{2}})(?:\[[^\]]+\]|\s+\w+/\w+)?$', 1) AS o,
        CASE WHEN regexp_matches(x, '\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?Z$') THEN 'UTC' ELSE regexp_extract(x, ':\d{{2}}(?:\.\d+)?\s+([A-Z]{{3,4}}|[A-Z][a-z]+/[A-Za-z_]+)$', 1) END AS z,
        regexp_replace(x, '(:\d{{2}}(?:\.\d+)?)(?:Z|\s*(?:GMT|UTC)?\s*[+-]\d{{2}}:?\d{{2}}(?:\[[^\]]+\]|\s+\w+/\w+)?|\s+(?:[A-Z]{{3,4}}|[A-Z][a-z]+/[A-Za-z_]+))$', '\1') AS body
        FROM texts LEFT JOIN feeds USING (feed_id) WHERE x IS NOT NULL),
    walls AS (SELECT *, coalesce(try_strptime(body, [{_UNORDERED}]), CASE date_order WHEN 'DMY' THEN try_strptime(body, [{_ORDERED("%d/%m")}]) WHEN 'MDY' THEN try_strptime(body, [{_ORDERED("%m/%d")}]) END) AS w,
        CASE WHEN z LIKE '%/%' THEN z WHEN z = '' THEN tz_name END AS rule FROM apart),
    ruled AS (SELECT *, timezone(rule, w) AS late FROM walls),
    parsed AS (SELECT row_id, field, CASE
        WHEN regexp_matches(x, '^\d{{10}}$') THEN CAST(x AS BIGINT) * 1000 WHEN regexp_matches(x, '^\d{{13}}$') THEN CAST(x AS BIGINT)
        WHEN o <> '' THEN epoch_ms(w) - (CASE WHEN o[1] = '-' THEN -60000 ELSE 60000 END) * (CAST(o[2:3] AS BIGINT) * 60 + CAST(o[-2:] AS BIGINT))
        WHEN z <> '' AND z NOT LIKE '%/%' THEN epoch_ms(w) - {_SHIFTS}[z] * 60000
        WHEN timezone(rule, late - INTERVAL 1 HOUR) = w THEN epoch_ms(late - INTERVAL 1 HOUR) ELSE epoch_ms(late) END AS utc_ms FROM ruled),
    merged AS (SELECT coalesce(nullif(upper(regexp_replace(visit_id, '[^\p{{L}}\p{{N}}]', '', 'g')), ''), 'row ' || row_id) AS visit, max(nurse_id) AS nurse_id, max(s.utc_ms) AS s, max(e.utc_ms) AS e
        FROM visits LEFT JOIN (SELECT * FROM parsed WHERE field = 'visit_start_time') s USING (row_id) LEFT JOIN (SELECT * FROM parsed WHERE field = 'visit_end_time') e USING (row_id) GROUP BY 1)"""
ORACLE = {
    "p2_found": f"""WITH {INSTANTS}, opened AS (SELECT nurse_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY nurse_id ORDER BY s) <= 7200000 THEN 0 ELSE 1 END AS o FROM merged WHERE nurse_id IS NOT NULL AND s IS NOT NULL),
        numbered AS (SELECT *, sum(o) OVER (PARTITION BY nurse_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM opened)
        SELECT nurse_id, min(s) AS start_ms, max(s) AS end_ms, count(*) AS visit_count FROM numbered GROUP BY nurse_id, k""",
    "p3_found": f"""WITH {INSTANTS}, kept AS (SELECT * FROM merged WHERE nurse_id IS NOT NULL AND s IS NOT NULL AND e >= s),
        opened AS (SELECT nurse_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY nurse_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM kept),
        numbered AS (SELECT *, sum(o) OVER (PARTITION BY nurse_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM opened),
        periods AS (SELECT nurse_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY nurse_id, k),
        followed AS (SELECT *, lead(s) OVER (PARTITION BY nurse_id ORDER BY s) AS n FROM periods)
        SELECT nurse_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods UNION ALL SELECT nurse_id, 'gap', e, n FROM followed WHERE n - e <= 43200000""",
    "p5_found": f"WITH {INSTANTS} SELECT row_id, field, utc_ms FROM parsed WHERE utc_ms IS NOT NULL",
    "p7_found": """
        SELECT row_id, 'review_scores_rating' AS field FROM listings
        WHERE review_scores_rating IS NULL OR isnan(review_scores_rating)
           OR NOT (review_scores_rating BETWEEN 1 AND 5 OR review_scores_rating BETWEEN 20 AND 100)
        UNION ALL
        SELECT row_id, 'bedrooms' FROM listings
        WHERE bedrooms IS NULL OR isnan(bedrooms) OR NOT bedrooms BETWEEN 0 AND 20 OR bedrooms <> floor(bedrooms)""",    "p7_same_listing": """
        WITH seen AS (SELECT row_id, id, last_scraped,
                CASE WHEN review_scores_rating BETWEEN 1 AND 5 THEN review_scores_rating WHEN review_scores_rating BETWEEN 20 AND 100 THEN review_scores_rating / 20 END AS rating,
                CASE WHEN bedrooms BETWEEN 0 AND 20 AND bedrooms = floor(bedrooms) THEN bedrooms END AS rooms FROM listings),
            long AS (SELECT 'review_scores_rating' AS field, row_id, id, last_scraped, rating AS y FROM seen UNION ALL SELECT 'bedrooms', row_id, id, last_scraped, rooms FROM seen),
            newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, id ORDER BY last_scraped DESC, row_id DESC) AS k FROM long WHERE y IS NOT NULL AND id IS NOT NULL) WHERE k = 1),
            asked AS (SELECT l.field, l.row_id, n.row_id AS donor_row_id, n.y AS value FROM long l LEFT JOIN newest n ON n.field = l.field AND n.id = l.id WHERE l.y IS NULL)
        SELECT field, row_id, donor_row_id, value FROM asked WHERE donor_row_id IS NOT NULL
        UNION ALL SELECT field, count(*), NULL, NULL FROM asked WHERE donor_row_id IS NULL GROUP BY 1""",
}

"""The pipeline of home visits from raw rows to the tables behind its charts, each with its SQL.

Keep the first row of a visit id, resolve times, drop visits without end, measure minutes, remove what lies beyond the fences, then
the way since the nurse's visit before, and what the notes tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.timestamps import with_instant
from tidemark.operators import relational as rel
from tidemark.operators import statistics as st
from tidemark.plans.problems import INSTANTS
from tidemark.plans.visits import with_feed
from tidemark.session import cut, load, stored_once

#: Order in which urgencies are shown.
URGENCY_ORDER = ("Asap", "Critical", "Urgent", "Action", "Review", "Monitoring", "Ongoing Assessment", "Follow-Up", "None")


def _named(rows: DataFrame, entries: DataFrame, field: str, out: str) -> DataFrame:
    """``out``: the canonical value that ``field`` is, blanks at its ends and case aside, else 'Other'."""
    known = entries.where(F.col("field") == field).select(F.lower("canonical_value").alias("_key"), F.col("canonical_value").alias("_name"))
    return rows.withColumn("_key", F.lower(text.stripped(F.col(field)))).join(known, "_key", "left").withColumn(out, F.coalesce("_name", F.lit("Other"))).drop("_key", "_name")


def clean_visits(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each visit id: row_id, nurse_id, start_ms, end_ms, service, location, urgency, status, minutes (null without
    end), kept (whether the minutes lie within the fences), travel (minutes from the end of the nurse's kept visit before)."""
    columns = ["row_id", "visit_id", "nurse_id", "visit_start_time", "visit_end_time", "service_type", "visit_location", "nurse_notes", "feed_id"]
    first = rel.dedupe_keep_first(load(spark, d, "visits").select(*columns).where("visit_id is not null"), ["visit_id"], [F.col("row_id")])
    timed = with_instant(with_feed(spark, d, first), "visit_start_time", "tz_name", "date_order", "start_ms")
    timed = with_instant(timed, "visit_end_time", "tz_name", "date_order", "end_ms")
    entries = load(spark, d, "canonical_values")
    named = _named(_named(timed, entries, "service_type", "service"), entries, "visit_location", "location")
    note = F.coalesce("nurse_notes", F.lit("No notes provided"))
    minutes = (F.col("end_ms") - F.col("start_ms")) / 60_000.0
    rows = cut(named.select("row_id", "nurse_id", "start_ms", "end_ms", "service", "location", text.note_urgency(note).alias("urgency"), text.note_status(note).alias("status"), minutes.alias("minutes")))
    limits = st.fences(rows, "minutes").select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    rows = rows.crossJoin(F.broadcast(limits)).withColumn("kept", F.coalesce(F.col("minutes").between(F.col("_low"), F.col("_high")), F.lit(False))).drop("_low", "_high")
    kept = rows.where("kept").select("row_id", "nurse_id", F.timestamp_millis("start_ms").alias("start_at"), F.timestamp_millis("end_ms").alias("end_at"))
    moved = rel.with_previous(kept, "nurse_id", "start_at", "row_id", F.col("end_at"), "before")
    travel = moved.select("row_id", rel.mask_range(dates.minutes_between(F.col("before"), F.col("start_at")), 0, 240).alias("travel"))
    return rows.join(travel, "row_id", "left")


def _clean(spark, d):
    """The cleaned visits, written when a query of the session first asks for them."""
    return spark.read.parquet(stored_once(spark, ("visits", d), lambda to: clean_visits(spark, d).write.parquet(to)))


def _measured(spark, d):
    return _clean(spark, d).where("end_ms is not null")


def _kept(spark, d):
    return _clean(spark, d).where("kept")


def _both(spark, d):
    return rel.stacked([_measured(spark, d).select(F.lit("before").alias("phase"), "minutes"), _kept(spark, d).select(F.lit("after").alias("phase"), "minutes")])


def visit_steps(spark, d):
    """Rows before and after each step of the cleaning, by one pass over the cleaned visits."""
    raw = load(spark, d, "visits").agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("raw").alias("step"), "row_count")
    counts = _clean(spark, d).agg(F.count(F.lit(1)).alias("a"), F.count("end_ms").alias("b"), F.count_if("kept").alias("c"))
    steps = F.array(*[F.struct(F.lit(n).alias("step"), F.col(c).alias("row_count")) for n, c in (("keep_first", "a"), ("with_end", "b"), ("within_fences", "c"))])
    return raw.unionAll(counts.select(F.inline(steps)))


def visit_minutes(spark, d):
    """Mean and spread of the minutes before and after the fences."""
    return _both(spark, d).groupBy("phase").agg(F.count("minutes").alias("n"), F.round(F.avg("minutes"), 6).alias("mean"), F.round(F.stddev_samp("minutes"), 6).alias("std"))


def visit_histogram(spark, d):
    """40 bins of the minutes before and after the fences."""
    parts = [st.histogram(f, "minutes", 40).select(F.lit(phase).alias("phase"), "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n") for phase, f in (("before", _measured(spark, d)), ("after", _kept(spark, d)))]
    return rel.stacked(parts)


def visit_by_service(spark, d):
    means = _kept(spark, d).groupBy("service").agg(F.avg("minutes").alias("m"), F.count(F.lit(1)).alias("n"), F.stddev_samp("minutes").alias("s"))
    return means.orderBy(F.desc("m"), "service").select("service", F.bround("m", 2).alias("avg_min"), "n", F.bround("s", 2).alias("std_min"))


def _box(spark, d, key):
    box = st.boxplot(_kept(spark, d), key, "minutes")
    return box.select(key, *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "fliers")


def visit_box_by_service(spark, d):
    """Box plots in the order of their medians."""
    return _box(spark, d, "service").orderBy("median", "service")


def visit_box_by_location(spark, d):
    return _box(spark, d, "location").orderBy("location")


def visit_fliers(spark, d):
    """The visits beyond the whiskers of their service."""
    return st.fliers(_kept(spark, d), "service", "minutes").select("row_id", "service", F.round("minutes", 6).alias("minutes"))


def visit_by_location(spark, d):
    kept = _kept(spark, d)
    means = kept.groupBy("location").agg(F.avg("minutes").alias("m"))
    return means.crossJoin(F.broadcast(kept.agg(F.avg("minutes").alias("o")))).select("location", F.round("m", 6).alias("mean"), (F.col("m") > F.col("o")).alias("above_mean"))


def visit_kruskal(spark, d):
    return st.kruskal_decided(_kept(spark, d), "location", "minutes").select(F.round("h", 4).alias("h"), "groups", "n", F.round("p", 6).alias("p"), "differs")


def visit_travel(spark, d):
    """The three nurses with the longest and the shortest ways, and the mean of all nurses' means beside them."""
    nurses = _kept(spark, d).where("nurse_id is not null and travel is not null").groupBy("nurse_id").agg(F.round(F.avg("travel"), 6).alias("mean_travel"))
    fleet = nurses.agg(F.round(F.avg("mean_travel"), 4).alias("fleet_mean"))
    return rel.top_bottom(nurses, "mean_travel", "nurse_id", 3).crossJoin(F.broadcast(fleet))


def visit_status_counts(spark, d):
    return st.value_counts(_kept(spark, d), "status").orderBy(F.desc("n"), "status")


def visit_by_urgency(spark, d):
    """Mean minutes by urgency, in the fixed order of urgencies."""
    means = _kept(spark, d).groupBy("urgency").agg(F.round(F.avg("minutes"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return rel.ordered_reindex(means, "urgency", URGENCY_ORDER).orderBy("position")


def visit_by_status(spark, d):
    return _kept(spark, d).groupBy("status").agg(F.round(F.avg("minutes"), 6).alias("mean")).orderBy(F.desc("mean"), "status")


def visit_nurses(spark, d):
    """Of each nurse with a known way the mean minutes, the mean way and the number of visits."""
    nurses = _kept(spark, d).where("nurse_id is not null").groupBy("nurse_id").agg(F.avg("minutes").alias("m"), F.avg("travel").alias("t"), F.count(F.lit(1)).alias("n"))
    return nurses.where("t is not null").select("nurse_id", F.round("m", 6).alias("mean_minutes"), F.round("t", 6).alias("mean_travel"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        visit_steps, visit_minutes, visit_histogram, visit_by_service, visit_box_by_service, visit_box_by_location, visit_fliers, visit_by_location, visit_kruskal, visit_travel, visit_status_counts, visit_by_urgency,
        visit_by_status, visit_nurses,
    )
}

_BASE = rf"""WITH {INSTANTS},
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY row_id) AS k FROM visits WHERE visit_id IS NOT NULL) WHERE k = 1),
    timed AS (SELECT f.row_id, nurse_id, s.utc_ms AS start_ms, e.utc_ms AS end_ms, coalesce(c.canonical_value, 'Other') AS service, coalesce(l.canonical_value, 'Other') AS location,
            lower(regexp_extract(nurse_notes, '(?i)\b(asap|critical|urgent|action|review|monitoring|ongoing assessment|follow-up)\b', 1)) AS u, lower(regexp_extract(nurse_notes, '(?i)the patient is (stable|in pain|dizzy|weak|restless|comfortable|improving)', 1)) AS p
        FROM firsts f LEFT JOIN (SELECT * FROM parsed WHERE field = 'visit_start_time') s ON s.row_id = f.row_id LEFT JOIN (SELECT * FROM parsed WHERE field = 'visit_end_time') e ON e.row_id = f.row_id
            LEFT JOIN canonical_values c ON c.field = 'service_type' AND lower(c.canonical_value) = lower(regexp_replace(f.service_type, '^\s+|\s+$', '', 'g')) LEFT JOIN canonical_values l ON l.field = 'visit_location' AND lower(l.canonical_value) = lower(regexp_replace(f.visit_location, '^\s+|\s+$', '', 'g'))),
    measured AS (SELECT *, (end_ms - start_ms) / 60000.0::DOUBLE AS minutes, CASE WHEN u IS NULL OR u = '' THEN 'None' WHEN u = 'ongoing assessment' THEN 'Ongoing Assessment' WHEN u = 'follow-up' THEN 'Follow-Up' ELSE upper(u[1]) || u[2:] END AS urgency,
            CASE WHEN p IS NULL OR p = '' THEN 'Unknown' WHEN p = 'in pain' THEN 'In Pain' ELSE upper(p[1]) || p[2:] END AS status FROM timed WHERE end_ms IS NOT NULL),
    fence AS (SELECT quantile_cont(minutes, 0.25) AS a, quantile_cont(minutes, 0.75) AS b FROM measured),
    kept AS (SELECT m.* FROM measured m, fence WHERE minutes BETWEEN a - 1.5::DOUBLE * (b - a) AND b + 1.5::DOUBLE * (b - a)),
    moved AS (SELECT *, CASE WHEN g BETWEEN 0 AND 240 THEN g END AS travel FROM (SELECT *, (start_ms - lag(end_ms) OVER (PARTITION BY nurse_id ORDER BY start_ms, row_id)) / 60000.0::DOUBLE AS g FROM kept))"""
_HISTOGRAM = "SELECT '{phase}' AS phase, bin, round(lo + (bin - 1) * w, 6) AS low, round(lo + bin * w, 6) AS high, count(*) AS n FROM (SELECT CAST(least(floor((minutes - lo) / ((hi - lo) / 40)) + 1, 40) AS INTEGER) AS bin, lo, (hi - lo) / 40 AS w FROM {t}, (SELECT min(minutes) AS lo, max(minutes) AS hi FROM {t}) WHERE minutes IS NOT NULL) GROUP BY ALL"
_BOXES = "q AS (SELECT {k} AS key, quantile_cont(minutes, 0.25) AS q1, quantile_cont(minutes, 0.5) AS median, quantile_cont(minutes, 0.75) AS q3 FROM kept GROUP BY 1), j AS (SELECT *, minutes BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM kept JOIN q ON key = {k})"
_BOX = lambda k: f"{_BASE}, {_BOXES.format(k=k)} SELECT {k}, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(minutes) FILTER (ok), 6) AS whisker_low, round(max(minutes) FILTER (ok), 6) AS whisker_high, count(*) FILTER (NOT ok) AS fliers FROM j GROUP BY 1"
ORACLE = {
    "visit_steps": f"{_BASE} SELECT 'raw' AS step, count(*) AS row_count FROM visits UNION ALL SELECT 'keep_first', count(*) FROM timed UNION ALL SELECT 'with_end', count(*) FROM measured UNION ALL SELECT 'within_fences', count(*) FROM kept",
    "visit_minutes": f"{_BASE} SELECT 'before' AS phase, count(minutes) AS n, round(avg(minutes), 6) AS mean, round(stddev_samp(minutes), 6) AS std FROM measured UNION ALL SELECT 'after', count(minutes), round(avg(minutes), 6), round(stddev_samp(minutes), 6) FROM kept",
    "visit_histogram": f"{_BASE} {_HISTOGRAM.format(phase='before', t='measured')} UNION ALL {_HISTOGRAM.format(phase='after', t='kept')}",
    "visit_by_service": f"{_BASE} SELECT service, round_even(avg(minutes), 2) AS avg_min, count(*) AS n, round_even(stddev_samp(minutes), 2) AS std_min FROM kept GROUP BY 1",
    "visit_box_by_service": _BOX("service"),
    "visit_box_by_location": _BOX("location"),
    "visit_fliers": f"{_BASE}, {_BOXES.format(k='service')} SELECT row_id, service, round(minutes, 6) AS minutes FROM j WHERE NOT ok",
    "visit_by_location": f"{_BASE} SELECT location, round(avg(minutes), 6) AS mean, avg(minutes) > (SELECT avg(minutes) FROM kept) AS above_mean FROM kept GROUP BY 1",
    "visit_kruskal": f"{_BASE}, " + st.KRUSKAL_SQL.format(key="location", value="minutes", table="kept") + " SELECT round(h, 4) AS h, groups, n, round(p, 6) AS p, p < 0.05 AS differs FROM tested",
    "visit_travel": f"{_BASE}, m AS (SELECT nurse_id, round(avg(travel), 6) AS mean_travel FROM moved WHERE nurse_id IS NOT NULL AND travel IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY mean_travel DESC, nurse_id) AS t, row_number() OVER (ORDER BY mean_travel, nurse_id) AS b, round((SELECT avg(mean_travel) FROM m), 4) AS fleet_mean FROM m) SELECT nurse_id, mean_travel, CAST(t AS INTEGER) AS place, 'top' AS side, fleet_mean FROM r WHERE t <= 3 UNION ALL SELECT nurse_id, mean_travel, CAST(b AS INTEGER), 'bottom', fleet_mean FROM r WHERE b <= 3",
    "visit_status_counts": f"{_BASE} SELECT status, count(*) AS n FROM kept GROUP BY 1",
    "visit_by_urgency": f"{_BASE} SELECT urgency, CAST(CASE urgency WHEN 'Asap' THEN 0 WHEN 'Critical' THEN 1 WHEN 'Urgent' THEN 2 WHEN 'Action' THEN 3 WHEN 'Review' THEN 4 WHEN 'Monitoring' THEN 5 WHEN 'Ongoing Assessment' THEN 6 WHEN 'Follow-Up' THEN 7 ELSE 8 END AS INTEGER) AS position, round(avg(minutes), 6) AS mean, count(*) AS n FROM kept GROUP BY 1",
    "visit_by_status": f"{_BASE} SELECT status, round(avg(minutes), 6) AS mean FROM kept GROUP BY 1",
    "visit_nurses": f"{_BASE} SELECT nurse_id, round(avg(minutes), 6) AS mean_minutes, round(avg(travel), 6) AS mean_travel, count(*) AS n FROM moved WHERE nurse_id IS NOT NULL GROUP BY 1 HAVING count(travel) > 0",
}

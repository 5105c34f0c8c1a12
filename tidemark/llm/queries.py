"""The pN queries of the language-model problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import amount
from tidemark.functions.timestamps import with_instant
from tidemark.llm.bpe import encode_corpus
from tidemark.llm.canonical import UNMATCHED, map_values
from tidemark.llm.leakage import leaked_items
from tidemark.llm.notes import grade
from tidemark.llm.residue import residue
from tidemark.llm.sketch import log_sketch, merge_sketches, sketch_percentiles
from tidemark.llm.truth import discover
from tidemark.plans.problems import INSTANTS
from tidemark.plans.visits import visit_key, with_feed
from tidemark.session import cut, load

TOKENIZERS = "/opt/tokenizers"
AREA = ["neighbourhood_cleansed", "room_type"]
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


def p1_scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of prices by month of scrape, neighbourhood and room type: what is kept of a scrape to be combined later."""
    # One generated row each, so that the filter does not parse the price a second time.
    priced = load(spark, sf_dir, "listings").select(*AREA, F.date_format("last_scraped", "yyyy-MM").alias("scrape"), F.explode(F.array(amount(F.col("price")))).alias("amount")).where("amount is not null")
    return log_sketch(priced, ["scrape", *AREA], "amount")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the amount in price by neighbourhood and room type, within 1 %, from the combined sketches of all scrapes."""
    merged = merge_sketches(p1_scrapes(spark, sf_dir), AREA)
    found = sketch_percentiles(merged, AREA, SHARES)
    return found.select(*AREA, "n", *[F.round(c, 6).alias(c) for c in found.columns[3:]])


#: Parts into which the rows of a visit are spread until they are combined.
SALTS = 16


def _repeated(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """The named columns (row_id among them) of the rows of visits that share their visit id (as ``grp``) with another row.

    Rows are joined by visit id and a salt, so that an id that holds a third of all rows fills many tasks.
    """
    visits = load(spark, sf_dir, "visits").select(visit_key().alias("grp"), *columns).where("grp is not null")
    repeated = visits.groupBy("grp").count().where("count > 1").select("grp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = visits.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    return salted.join(repeated, ["grp", "_salt"], "left_semi").drop("_salt")


def _claims(rows: DataFrame, *fields) -> DataFrame:
    """What rows (with grp, feed_id, loaded_at, row_id) claim: fields as structs of field, value and grade."""
    common = [F.col("feed_id").alias("source"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("recency"), F.col("row_id").alias("place")]
    return rows.select("grp", *common, F.inline(F.array(*fields)))


def _plain(field: str, column: str):
    return F.struct(F.lit(field).alias("field"), F.col(column).cast("string").alias("value"), F.lit(0).alias("grade"))


def _note():
    return F.struct(F.lit("nurse_notes").alias("field"), F.col("row_id").cast("string").alias("value"), grade(F.col("nurse_notes")).alias("grade"))


def _priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "feeds").select(F.col("feed_id").alias("source"), (1.0 / (1 + F.col("trust_rank"))).alias("prior"))


def _wide(winners: DataFrame, fields: list[str]) -> DataFrame:
    return winners.groupBy("grp").pivot("field", fields).agg(F.first("value"))


def p4_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each visit with several rows, every field by its best supported value; notes_row_id holds the note kept.

    Services and locations are voted on by what they mean; a meaning beats a text that means nothing in the list.
    """
    columns = ["row_id", "nurse_id", "patient_id", "visit_start_time", "visit_end_time", "service_type", "visit_location", "nurse_notes", "feed_id", "loaded_at"]
    rows = cut(_repeated(spark, sf_dir, columns))
    timed = with_instant(with_feed(spark, sf_dir, rows), "visit_start_time", "tz_name", "date_order", "start_ms")
    timed = with_instant(timed, "visit_end_time", "tz_name", "date_order", "end_ms")
    claims = _claims(timed, _plain("nurse_id", "nurse_id"), _plain("patient_id", "patient_id"), _plain("visit_start_time", "start_ms"), _plain("visit_end_time", "end_ms"), _note())
    typed = rows.select("row_id", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("service_type", "visit_location")])))
    mapped = map_values(typed, "row_id", "field", "value", load(spark, sf_dir, "canonical_values"), "field", "canonical_value", "short_code")
    meant = typed.where("trim(value) <> ''").join(mapped, ["row_id", "field"], "left").select("row_id", "field", F.nullif(F.coalesce("canonical", "value"), F.lit(UNMATCHED)).alias("value"))
    claims = claims.unionByName(_claims(rows.join(meant, "row_id"), F.struct("field", "value", F.lit(0).alias("grade"))))
    fields = ["nurse_id", "patient_id", "visit_start_time", "visit_end_time", "service_type", "visit_location", "nurse_notes"]
    wide = _wide(discover(claims, _priors(spark, sf_dir), pinned=("nurse_notes",))[0], fields)
    times = [F.col(c).cast("bigint").alias(a) for c, a in (("visit_start_time", "start_ms"), ("visit_end_time", "end_ms"), ("nurse_notes", "notes_row_id"))]
    return wide.select(F.col("grp").alias("visit_id"), "nurse_id", "patient_id", "service_type", "visit_location", *times)


def p4_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the golden record on which SQL can be asked: people, times and the note kept."""
    return p4_golden(spark, sf_dir).drop("service_type", "visit_location")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row whose note survives, for each visit with several rows of which one tells something.

    The order of notes is fixed from outside (content, rank of the feed, arrival, row): content is the grade of a claim and the
    feeds' ranks are the pinned weights of this field. It leaves no ties, so there is nothing for rounds to learn.
    """
    rows = _repeated(spark, sf_dir, ["row_id", "nurse_notes", "feed_id", "loaded_at"])
    won = discover(_claims(rows, _note()), _priors(spark, sf_dir), pinned=("nurse_notes",), rounds=0)[0].where("grade > 0")
    return won.select(F.col("grp").alias("visit_id"), F.col("value").cast("bigint").alias("row_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each freely typed service and location means."""
    columns = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("service_type", "visit_location")])
    typed = load(spark, sf_dir, "visits").select("row_id", F.inline(columns))
    return map_values(typed, "row_id", "field", "value", load(spark, sf_dir, "canonical_values"), "field", "canonical_value", "short_code")


def p8_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(load(spark, sf_dir, "documents"), "doc_id", "text", f"{tokenizers}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold ten or more consecutive words of a benchmark item."""
    return leaked_items(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "benchmark"), "item_id", "text").select("doc_id", "item_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of an item in order with at most one other word between them; exact where there is none."""
    return leaked_items(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "benchmark"), "item_id", "text", slop=1)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue, filler, an error page or a script notice, or have some of it left beside real content,
    after the links that recur in most documents of a source are subtracted."""
    return residue(load(spark, sf_dir, "documents"), "doc_id", "text", "source").select("doc_id")


QUERIES = {"p1_percentiles": p1_percentiles, "p1_scrapes": p1_scrapes, "p4_found": p4_found, "p4_golden": p4_golden, "p4_known": p4_known, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_near": p9_near, "p10_found": p10_found}

_AMOUNT = r"""
    bare AS (SELECT *, regexp_replace(upper(price), '[\s\p{Z}]|ZAR|R|\$|€|£', '', 'g') AS b FROM listings),
    dotted AS (SELECT *, CASE WHEN regexp_matches(b, '^-?[0-9]+(\.[0-9]{3})*,[0-9]{1,2}$') THEN replace(replace(b, '.', ''), ',', '.') ELSE replace(b, ',', '') END AS d FROM bare),
    priced AS (SELECT *, CASE WHEN regexp_matches(d, '^-?[0-9]+(\.[0-9]+)?$') THEN CAST(d AS DOUBLE) END AS amount FROM dotted),
    bucketed AS (SELECT strftime(last_scraped, '%Y-%m') AS scrape, neighbourhood_cleansed, room_type, CAST(sign(amount) AS INTEGER) AS sign,
        CASE WHEN amount = 0 THEN 0 ELSE CAST(ceil(ln(abs(amount)) / ln(1.01::DOUBLE / 0.99::DOUBLE)) AS INTEGER) END AS bucket FROM priced WHERE amount IS NOT NULL)"""
ORACLE = {
    "p1_scrapes": f"WITH {_AMOUNT} SELECT scrape, neighbourhood_cleansed, room_type, sign, bucket, count(*) AS n FROM bucketed GROUP BY ALL",
    "p1_percentiles": f"""WITH {_AMOUNT},
        ranked AS (SELECT neighbourhood_cleansed, room_type, sign * pow(1.01::DOUBLE / 0.99::DOUBLE, bucket) * 2 / (1.01::DOUBLE / 0.99::DOUBLE + 1) AS v,
            row_number() OVER (PARTITION BY neighbourhood_cleansed, room_type ORDER BY sign, sign * bucket) - 1 AS r, count(*) OVER (PARTITION BY neighbourhood_cleansed, room_type) AS n FROM bucketed)
        SELECT neighbourhood_cleansed, room_type, max(n) AS n, """
    + ", ".join(f"round(max(v) FILTER (r = floor({q}::DOUBLE * (n - 1))), 6) AS p{round(q * 100)}" for q in SHARES)
    + " FROM ranked GROUP BY ALL",
    "p4_found": r"""WITH keyed AS (SELECT *, upper(regexp_replace(visit_id, '[^\p{L}\p{N}]', '', 'g')) AS k, regexp_replace(lower(nurse_notes), '\s+', ' ', 'g') AS t FROM visits),
        graded AS (SELECT k, row_id, loaded_at, coalesce(trust_rank, 1000000) AS rank, count(*) OVER (PARTITION BY k) AS rows_of,
            CAST(coalesce(regexp_matches(t, '\bthe nurse [a-z]+ed the [a-z][^.;,:]*[a-z] ?[.;,]') OR regexp_matches(t, '(^|; |\. )nurse [a-z]+ed [a-z][^.;,:]*[a-z] ?([.;,]|$)') OR regexp_matches(t, '^[a-z][^.;,:]* [a-z]+ed by nurse\.'), false) AS INTEGER)
            + CAST(coalesce(regexp_matches(t, '\b(patient|pt) (is )?(stable|improving|comfortable|restless|weak|dizzy|in pain)\b'), false) AS INTEGER) AS grade
            FROM keyed LEFT JOIN feeds USING (feed_id) WHERE k <> ''),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY grade DESC, rank, loaded_at DESC, row_id) AS place FROM graded WHERE rows_of > 1)
        SELECT k AS visit_id, row_id FROM ranked WHERE place = 1 AND grade > 0""",
    "p4_known": rf"""WITH {INSTANTS},
        keyed AS (SELECT v.*, s.utc_ms AS s, e.utc_ms AS e, upper(regexp_replace(visit_id, '[^\p{{L}}\p{{N}}]', '', 'g')) AS k, regexp_replace(lower(nurse_notes), '\s+', ' ', 'g') AS t FROM visits v
            LEFT JOIN (SELECT * FROM parsed WHERE field = 'visit_start_time') s USING (row_id) LEFT JOIN (SELECT * FROM parsed WHERE field = 'visit_end_time') e USING (row_id)),
        graded AS (SELECT keyed.*, coalesce(trust_rank, 1000000) AS rank, count(*) OVER (PARTITION BY k) AS rows_of,
            CAST(coalesce(regexp_matches(t, '\bthe nurse [a-z]+ed the [a-z][^.;,:]*[a-z] ?[.;,]') OR regexp_matches(t, '(^|; |\. )nurse [a-z]+ed [a-z][^.;,:]*[a-z] ?([.;,]|$)') OR regexp_matches(t, '^[a-z][^.;,:]* [a-z]+ed by nurse\.'), false) AS INTEGER)
            + CAST(coalesce(regexp_matches(t, '\b(patient|pt) (is )?(stable|improving|comfortable|restless|weak|dizzy|in pain)\b'), false) AS INTEGER) AS grade
            FROM keyed LEFT JOIN feeds USING (feed_id) WHERE k <> ''),
        placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY grade DESC, rank, loaded_at DESC, row_id) AS place FROM graded WHERE rows_of > 1)
        SELECT k AS visit_id, max(nurse_id) AS nurse_id, max(patient_id) AS patient_id, max(s) AS start_ms, max(e) AS end_ms, max(row_id) FILTER (place = 1) AS notes_row_id FROM placed GROUP BY 1""",
    "p9_found": r"""WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        split AS (SELECT side, id, regexp_extract_all(lower(strip_accents(regexp_replace(text, '[\p{Cf}\p{M}]', '', 'g'))), '[\p{L}\p{N}]+') AS w FROM texts WHERE text IS NOT NULL),
        grams AS (SELECT DISTINCT side, id, gram FROM (SELECT side, id, unnest(list_transform(generate_series(1, len(w) - 9), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM split WHERE len(w) >= 10))
        SELECT DISTINCT d.id AS doc_id, b.id AS item_id FROM grams d JOIN grams b USING (gram) WHERE d.side = 'd' AND b.side = 'b'""",
    "p9_near": r"""WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        split AS (SELECT side, id, regexp_extract_all(lower(strip_accents(regexp_replace(text, '[\p{Cf}\p{M}]', '', 'g'))), '[\p{L}\p{N}]+') AS w FROM texts WHERE text IS NOT NULL),
        grams AS (SELECT DISTINCT side, id, gram FROM (SELECT side, id, unnest(list_transform(generate_series(1, len(w) - 9), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM split WHERE len(w) >= 10)),
        -- eleven words of which one within is left out
        loose AS (SELECT DISTINCT id, array_to_string(list_concat(w[i:i + k], w[i + k + 2:i + 10]), ' ') AS gram FROM (SELECT id, w, unnest(generate_series(1, len(w) - 10)) AS i FROM split WHERE side = 'd' AND len(w) >= 11), generate_series(0, 8) t(k)),
        found AS (SELECT d.id AS doc_id, b.id AS item_id, true AS exact FROM grams d JOIN grams b USING (gram) WHERE d.side = 'd' AND b.side = 'b'
            UNION ALL SELECT d.id, b.id, false FROM loose d JOIN grams b USING (gram) WHERE b.side = 'b')
        SELECT doc_id, item_id, bool_or(exact) AS exact FROM found GROUP BY ALL""",
}

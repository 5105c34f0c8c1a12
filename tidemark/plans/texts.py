"""Queries of search and screening, each with its SQL where SQL can express it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.session import load, stored_once

QUERY = ("terrace", "harbour", "quiet")
# The terms that are timed, frequent and rare ones.
TIMED = (
    "terrace", "harbour", "quiet", "beach", "garden", "pool", "kitchen", "balcony", "market", "station", "school", "river", "mountain", "parking", "breakfast", "nurse", "visit",
    "patient", "pressure", "medication", "wound", "swap", "ticks", "trader", "order", "resale", "lease", "buyers", "renovation", "error", "template", "javascript", "judge", "zebra",
)
# Phrases that the screening of chats looks for, by category, and the rules that categories fall under.
DICTIONARY = (
    ("offline", "move it offline"), ("offline", "no more on chat"), ("secrecy", "keep this between us"), ("secrecy", "delete that"), ("secrecy", "treasury reads this"), ("orders", "pull the order"), ("orders", "show less size"),
    ("orders", "hold the bid"), ("orders", "roll the hedge"), ("information", "who told"), ("information", "compliance sees"), ("codewords", "sin decir nada"), ("codewords", "cafe"),
)
RULES = (("secrecy", "record keeping"), ("offline", "record keeping"), ("orders", "market manipulation"), ("information", "inside information"))


def _documents(spark, d):
    return load(spark, d, "documents").where("text is not null")


def _turns(spark, d):
    return search.chat_turns(load(spark, d, "documents").where("kind = 'trader_chat'"), "doc_id", "text")


def _dictionary(spark):
    return spark.createDataFrame(list(DICTIONARY), "category string, phrase string")


def _index(spark, d):
    """The index over the texts of documents, built and stored when a query of the session first asks for it."""
    path = stored_once(spark, ("documents", d), lambda to: search.save_index(search.build_index(_documents(spark, d), "doc_id", ["text"]), to))
    return search.StoredIndex(spark, path)


def like_scan(spark, d):
    return search.like_scan(load(spark, d, "documents"), ["text"], "beach").select("doc_id")


def like_columns(spark, d):
    return search.like_scan(load(spark, d, "listings"), ["amenities", "room_type", "neighbourhood_cleansed"], "pool").select("row_id")


def index_terms(spark, d):
    return _index(spark, d).rows.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


def index_of_columns(spark, d):
    return search.build_index(load(spark, d, "listings"), "row_id", ["amenities", "room_type"]).groupBy("term").agg(F.count(F.lit(1)).alias("listings"))


def match_any(spark, d):
    return search.match_any(_index(spark, d).postings(QUERY), "doc_id", QUERY)


def match_all(spark, d):
    return search.match_all(_index(spark, d).postings(QUERY[:2]), "doc_id", QUERY[:2])


def tfidf_top(spark, d):
    scored = search.tfidf(_index(spark, d).postings(QUERY), "doc_id", QUERY, _documents(spark, d))
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def like_against_index(spark, d):
    return search.search_difference(_documents(spark, d), _index(spark, d).postings(["bed"]), "doc_id", ["text"], "bed")


def fuzzy_listings(spark, d):
    found = search.fuzzy_search(load(spark, d, "listings"), "row_id", {"neighbourhood_cleansed": 20, "room_type": 20, "amenities": 10}, "entir home")
    return found.select("row_id", F.round("score", 6).alias("score"))


def search_speed(spark, d):
    """Each term looked up in the stored index and scanned for: matches, rows examined, mean milliseconds of ten runs, and how many times faster the index is."""
    documents, index = _documents(spark, d), _index(spark, d)
    runs = {f"index {t}": lambda t=t: search.match_any(index.postings([t]), "doc_id", [t]) for t in TIMED} | {f"like {t}": lambda t=t: search.like_scan(documents, ["text"], t) for t in TIMED}
    measured = {r["name"]: r for r in search.compare_speed(runs)}
    rows = [(*r.values(), measured[f"like {name.partition(' ')[2]}"]["mean_ms"] / max(r["mean_ms"], 1e-9)) for name, r in measured.items()]
    return spark.createDataFrame(rows, "name string, matches bigint, rows_examined bigint, mean_ms double, speed_up double")


def chat_turns(spark, d):
    return _turns(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("speaker").alias("speakers"), F.min("minute").alias("first_minute"), F.sum(F.length("message")).alias("message_chars"))


def keyword_screen(spark, d):
    return search.keyword_screen(_turns(spark, d), _dictionary(spark)).select("doc_id", "turn", "category", "phrase")


def keyword_context(spark, d):
    turns = _turns(spark, d)
    hits = search.keyword_screen(turns, _dictionary(spark)).select("doc_id", "turn").distinct().withColumn("hit", F.lit(True))
    return search.context_window(turns.join(hits, ["doc_id", "turn"], "left"), "doc_id", F.coalesce("hit", F.lit(False))).select("doc_id", "turn", F.array_join("context", " / ").alias("context"))


def linked_behaviour(spark, d):
    m = F.lower("message")
    return search.linked_behaviour(_turns(spark, d), "doc_id", F.contains(m, F.lit("keep this between us")), F.contains(m, F.lit("done at")))


def novel_terms(spark, d):
    flagged = F.rlike(F.lower("message"), F.lit("keep this between us|move it offline|delete that"))
    return search.novel_terms(_turns(spark, d), flagged).select("term", "flagged_n", "total_n", F.round("lift", 6).alias("lift"))


def chat_alerts(spark, d):
    """Every hit with the rule its category falls under, waiting for a reviewer."""
    rules = spark.createDataFrame(list(RULES), "category string, rule string")
    return search.with_rules(search.keyword_screen(_turns(spark, d), _dictionary(spark)), rules).select("doc_id", "turn", "phrase", "category", "rule", F.lit("pending").alias("status"))


def chat_sources(spark, d):
    hits = search.keyword_screen(_turns(spark, d), _dictionary(spark))
    return hits.groupBy("category").agg(F.count_distinct("doc_id").alias("conversations"), F.count(F.lit(1)).alias("hits"))


def chat_intents(spark, d):
    """Messages scored by a function given from outside, here by how many of three words of secrecy they hold."""

    def secrecy(message: pd.Series) -> pd.Series:
        low = message.str.lower()
        return sum(low.str.contains(w, regex=False).astype(float) for w in ("between us", "delete", "offline")) / 2

    scored = search.classified(_turns(spark, d), secrecy)
    return scored.groupBy("intent").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("doc_id").alias("conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        like_scan, like_columns, index_terms, index_of_columns, match_any, match_all, tfidf_top, like_against_index, fuzzy_listings, search_speed, chat_turns, keyword_screen, keyword_context, linked_behaviour, novel_terms,
        chat_alerts, chat_sources, chat_intents,
    )
}

_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_WORDS = r"flatten(list_transform(list_filter(string_split_regex(lower(nfc_normalize({})), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> ''), lambda t: CASE WHEN length(t) > 2 AND regexp_matches(t, '\p{{Han}}') THEN list_transform(generate_series(1, length(t) - 1), lambda i: substring(t, i, 2)) ELSE [t] END))"
_INDEX = f"idx AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents WHERE text IS NOT NULL) WHERE term NOT IN ({_STOP}) GROUP BY ALL)"
_TERMS = ", ".join(f"'{t}'" for t in QUERY)
_TURNS = r"""lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS turn FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '[^\S\r\n]\s*(\[\d\d:\d\d\] )', E'\n\\1', 'g'), '\r\n|\r|\n') AS l FROM documents WHERE kind = 'trader_chat' AND text IS NOT NULL)),
    turns AS (SELECT doc_id, CAST(turn AS INTEGER) AS turn, CAST(regexp_extract(line, p, 1) AS INTEGER) * 60 + CAST(regexp_extract(line, p, 2) AS INTEGER) AS minute, regexp_extract(line, p, 3) AS speaker, regexp_extract(line, p, 4) AS message
        FROM lines, (SELECT '(?s)^\s*\[(\d\d):(\d\d)\] ([^:\s]+): (.*)$' AS p) WHERE regexp_matches(line, p))"""
_HITS = (
    "dictionary(category, phrase) AS (VALUES ('offline', 'move it offline'), ('offline', 'no more on chat'), ('secrecy', 'keep this between us'), ('secrecy', 'delete that'), ('secrecy', 'treasury reads this'), ('orders', 'pull the order'), ('orders', 'show less size'), "
    "('orders', 'hold the bid'), ('orders', 'roll the hedge'), ('information', 'who told'), ('information', 'compliance sees'), ('codewords', 'sin decir nada'), ('codewords', 'cafe')), "
    r"hits AS (SELECT doc_id, turn, message, category, phrase FROM turns JOIN dictionary ON regexp_matches(lower(message), '(^|[^\p{L}\p{M}\p{N}])' || phrase || '($|[^\p{L}\p{M}\p{N}])'))"
)
_NEAR = lambda column, word: f"list_min(list_transform({_WORDS.format(column)}, lambda t: levenshtein(t, '{word}') / greatest(length(t), {len(word)})))"
_FUZZY = ", ".join(f"CASE WHEN len({_WORDS.format(c)}) > 0 THEN ({_NEAR(c, 'entir')} + {_NEAR(c, 'home')}) / 2 END AS {a}" for c, a in (("neighbourhood_cleansed", "a"), ("room_type", "b"), ("amenities", "c")))
ORACLE = {
    "like_scan": "SELECT doc_id FROM documents WHERE text ILIKE '%beach%'",
    "like_columns": "SELECT row_id FROM listings WHERE coalesce(amenities ILIKE '%pool%', false) OR coalesce(room_type ILIKE '%pool%', false) OR coalesce(neighbourhood_cleansed ILIKE '%pool%', false)",
    "index_terms": f"WITH {_INDEX} SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM idx GROUP BY 1",
    "index_of_columns": f"WITH w AS (SELECT row_id, unnest({_WORDS.format('amenities')}) AS term FROM listings WHERE amenities IS NOT NULL UNION ALL SELECT row_id, unnest({_WORDS.format('room_type')}) FROM listings WHERE room_type IS NOT NULL) SELECT term, count(DISTINCT row_id) AS listings FROM w WHERE term NOT IN ({_STOP}) GROUP BY 1",
    "match_any": f"WITH {_INDEX} SELECT DISTINCT doc_id FROM idx WHERE term IN ({_TERMS})",
    "match_all": f"WITH {_INDEX} SELECT doc_id FROM idx WHERE term IN ('{QUERY[0]}', '{QUERY[1]}') GROUP BY 1 HAVING count(DISTINCT term) = 2",
    "tfidf_top": f"WITH {_INDEX}, h AS (SELECT * FROM idx WHERE term IN ({_TERMS})), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1) SELECT doc_id, round(sum(tf * ln((SELECT count(*) FROM documents WHERE text IS NOT NULL)::DOUBLE / df)), 6) AS score FROM h JOIN f USING (term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "like_against_index": f"WITH {_INDEX}, a AS (SELECT doc_id FROM documents WHERE text ILIKE '%bed%'), b AS (SELECT doc_id FROM idx WHERE term = 'bed') SELECT doc_id, 'like' AS found_by FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'index' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)",
    "fuzzy_listings": f"WITH s AS (SELECT row_id, {_FUZZY} FROM listings) SELECT row_id, round((CASE WHEN a <= 0.1 THEN pow(a + 0.001, 0.4) ELSE 1 END) * (CASE WHEN b <= 0.1 THEN pow(b + 0.001, 0.4) ELSE 1 END) * (CASE WHEN c <= 0.1 THEN pow(c + 0.001, 0.2) ELSE 1 END), 6) AS score FROM s WHERE a <= 0.1 OR b <= 0.1 OR c <= 0.1",
    "chat_turns": f"WITH {_TURNS} SELECT doc_id, count(*) AS turns, count(DISTINCT speaker) AS speakers, min(minute) AS first_minute, CAST(sum(length(message)) AS BIGINT) AS message_chars FROM turns GROUP BY 1",
    "keyword_screen": f"WITH {_TURNS}, {_HITS} SELECT doc_id, turn, category, phrase FROM hits",
    "keyword_context": f"WITH {_TURNS}, {_HITS}, around AS (SELECT doc_id, turn, string_agg(message, ' / ') OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM turns) SELECT * FROM around WHERE (doc_id, turn) IN (SELECT doc_id, turn FROM hits)",
    "linked_behaviour": f"WITH {_TURNS}, pairs AS (SELECT a.doc_id, a.turn AS first_turn, min(b.turn) AS then_turn FROM turns a JOIN turns b ON a.doc_id = b.doc_id AND b.turn > a.turn WHERE contains(lower(a.message), 'keep this between us') AND contains(lower(b.message), 'done at') GROUP BY ALL) SELECT doc_id, min(first_turn) AS first_turn, arg_min(then_turn, first_turn) AS then_turn FROM pairs GROUP BY 1",
    "novel_terms": f"WITH {_TURNS}, w AS (SELECT regexp_matches(lower(message), 'keep this between us|move it offline|delete that') AS f, unnest({_WORDS.format('message')}) AS term FROM turns), c AS (SELECT term, count(*) FILTER (f) AS flagged_n, count(*) AS total_n FROM w GROUP BY 1), l AS (SELECT *, (flagged_n / sum(flagged_n) OVER ()::DOUBLE) / (total_n / sum(total_n) OVER ()::DOUBLE) AS lift FROM c) SELECT term, flagged_n, total_n, round(lift, 6) AS lift FROM l WHERE flagged_n >= 5 AND lift > 1",
    "chat_alerts": f"WITH {_TURNS}, {_HITS} SELECT doc_id, turn, phrase, category, CASE category WHEN 'secrecy' THEN 'record keeping' WHEN 'offline' THEN 'record keeping' WHEN 'orders' THEN 'market manipulation' WHEN 'information' THEN 'inside information' END AS rule, 'pending' AS status FROM hits",
    "chat_sources": f"WITH {_TURNS}, {_HITS} SELECT category, count(DISTINCT doc_id) AS conversations, count(*) AS hits FROM hits GROUP BY 1",
    "chat_intents": f"WITH {_TURNS}, s AS (SELECT doc_id, CAST(contains(lower(message), 'between us') AS INTEGER) + CAST(contains(lower(message), 'delete') AS INTEGER) + CAST(contains(lower(message), 'offline') AS INTEGER) AS n FROM turns) SELECT CASE WHEN n >= 1 THEN 'suspicious' ELSE 'legitimate' END AS intent, count(*) AS turns, count(DISTINCT doc_id) AS conversations FROM s GROUP BY 1",
}

"""Text search by inverted index, its wildcard counterpart, and the screening of conversations."""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: words an index leaves out unless told otherwise.
STOP_WORDS = ("a", "about", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "who", "will", "with")


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(text: Column) -> Column:
    """The text in normal form C. Only texts with combining marks leave the JVM for it."""
    marked = F.rlike(text, F.lit(r"\p{M}"))
    return F.when(marked, F.pandas_udf(_nfc, "string")(F.when(marked, text))).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case words, runs of letters, marks and digits; of words with Han characters their overlapping pairs of characters."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    return F.flatten(F.transform(found, lambda t: F.when((F.length(t) > 2) & F.rlike(t, F.lit(r"\p{IsHan}")), pairs(t)).otherwise(F.array(t))))


def build_index(df: DataFrame, row_id: str, columns: Sequence[str], stop_words: Sequence[str] = STOP_WORDS, least: int = 1) -> DataFrame:
    """Inverted index over one or more text columns: term, row id, tf. Counts are combined before the shuffle.

    Null texts have no terms. ``save_index`` stores it for use by many queries.
    """
    # Generated rows, one each, so that the composed texts are plain columns to what follows.
    texts = df.select(F.col(row_id), F.inline(F.array(F.struct(*[composed(F.col(c)).alias(f"_t{k}") for k, c in enumerate(columns)]))))
    words = F.explode(reduce(F.concat, [F.coalesce(tokens(F.col(f"_t{k}")), F.array().cast("array<string>")) for k in range(len(columns))]))
    kept = texts.select(F.col(row_id), words.alias("term")).where((F.length("term") >= least) & ~F.col("term").isin(*stop_words) if stop_words else F.length("term") >= least)
    return kept.groupBy("term", row_id).agg(F.count(F.lit(1)).alias("tf"))


#: Folders into which a stored index is split by the hash of the term; a lookup opens those of its terms only.
SHARDS = 64


def save_index(index: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The index as Parquet in folders by hash of the term, in each sorted by term, so that a lookup reads the row groups of its terms only.

    Rows are placed by term and row, so a term that holds a large part of all postings is spread over several files.
    """
    rows = [c for c in index.columns if c not in ("term", "tf")]
    placed = index.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    placed.repartitionByRange("shard", "term", *rows).sortWithinPartitions("shard", "term").write.mode("overwrite").option("parquet.block.size", 8_000_000).partitionBy("shard").parquet(path)


class StoredIndex:
    """A stored index: its listing of files is made once, and lookups are pruned to the folders and row groups of their terms."""

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS) -> None:
        self.rows, self.shards = spark.read.parquet(path), shards

    def postings(self, query: Sequence[str]) -> DataFrame:
        """term, row id, tf of the terms of a query."""
        terms = sorted(set(query))
        # Constant to the optimiser, which prunes the folders by it.
        shards = [F.pmod(F.xxhash64(F.lit(t)), F.lit(self.shards)).cast("int") for t in terms]
        return self.rows.where(F.col("shard").isin(*shards) & F.col("term").isin(*terms)).drop("shard") if terms else self.rows.where(F.lit(False)).drop("shard")


def match_any(index: DataFrame, row_id: str, query: Sequence[str]) -> DataFrame:
    """Rows that hold any of the query's terms; the filter on term reaches the scan of a stored index."""
    found = index.where(F.col("term").isin(*query)).select(row_id)
    return found if len(set(query)) == 1 else found.distinct()


def match_all(index: DataFrame, row_id: str, query: Sequence[str]) -> DataFrame:
    """Rows that hold all of the query's terms."""
    wanted = sorted(set(query))
    return index.where(F.col("term").isin(*wanted)).groupBy(row_id).agg(F.count_distinct("term").alias("_n")).where(F.col("_n") == len(wanted)).select(row_id)


def tfidf(index: DataFrame, row_id: str, query: Sequence[str], documents: DataFrame) -> DataFrame:
    """row id and score of the rows that match: the sum of tf * ln(N / df)."""
    n = documents.agg(F.count(F.lit(1)).alias("_total"))
    hits = index.where(F.col("term").isin(*query))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(n))
    return scored.groupBy(row_id).agg(F.sum(F.col("tf") * F.log(F.col("_total") / F.col("_df"))).alias("score"))


def fuzzy_search(df: DataFrame, row_id: str, weights: Mapping[str, float], query: str, threshold: float = 0.1, least: int = 2) -> DataFrame:
    """row id and score (0 best, at most ``threshold``) of rows in which words like those of the query stand.

    Of each column the score is the mean, over the query's words of ``least`` letters or more, of the least share of letters that
    differ between the word and a word of the column; columns are weighed by ``weights``, and the best column with a score counts
    in proportion to its weight. Null columns do not match. A former result may be given as ``df`` to narrow it down.
    """
    wanted = [w for w in query.lower().split() if len(w) >= least]
    total = sum(weights.values())
    texts = df.select(F.col(row_id), F.inline(F.array(F.struct(*[tokens(F.col(c)).alias(f"_w{k}") for k, c in enumerate(weights)]))))

    def distance(words: Column) -> Column:
        nearest = lambda w: F.array_min(F.transform(words, lambda t: F.levenshtein(t, F.lit(w)) / F.greatest(F.length(t), F.lit(len(w)))))
        return reduce(Column.__add__, map(nearest, wanted)) / len(wanted)

    if not wanted:
        return texts.where(F.lit(False)).select(row_id, F.lit(0.0).alias("score"))
    scores = [F.when(F.size(f"_w{k}") > 0, distance(F.col(f"_w{k}"))) for k in range(len(weights))]
    weighed = [F.when(s <= threshold, F.pow(s + 0.001, F.lit(w / total))) for s, w in zip(scores, weights.values(), strict=True)]
    product = reduce(Column.__mul__, [F.coalesce(x, F.lit(1.0)) for x in weighed])
    hit = reduce(Column.__or__, [x.isNotNull() for x in weighed])
    return texts.select(row_id, F.when(hit, product).alias("score")).where("score is not null")


def like_scan(df: DataFrame, columns: Sequence[str], term: str) -> DataFrame:
    """Rows in which one of the columns holds the term, by a scan with wildcards, whatever the case."""
    return df.where(reduce(Column.__or__, [F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns]))


def search_difference(df: DataFrame, index: DataFrame, row_id: str, columns: Sequence[str], term: str) -> DataFrame:
    """Rows that only one of wildcard scan and index finds: row id, found_by."""
    scanned = like_scan(df, columns, term).select(row_id, F.lit(True).alias("_like"))
    matched = match_any(index, row_id, [term]).withColumn("_index", F.lit(True))
    both = scanned.join(matched, row_id, "full_outer")
    return both.where("_like is null or _index is null").select(row_id, F.when(F.col("_like"), "like").otherwise("index").alias("found_by"))


def compare_speed(runs: Mapping[str, Callable[[], DataFrame]], repeats: int = 10) -> list[dict]:
    """name, matches, rows examined (output of the scans) and mean milliseconds of each query, run ``repeats`` times."""
    out = []
    for name, make in runs.items():
        took, n = [], 0
        counted = make().agg(F.count(F.lit(1)))
        for _ in range(repeats):
            begun = time.perf_counter()
            n = counted.first()[0]
            took.append((time.perf_counter() - begun) * 1000)
        out.append({"name": name, "matches": n, "rows_examined": rows_examined(counted), "mean_ms": sum(took) / len(took)})
    return out


def rows_examined(df: DataFrame) -> int:
    """Rows that the scans of a query that has run gave out: those of the row groups that could not be skipped."""
    pending, total = [df._jdf.queryExecution().executedPlan()], 0
    while pending:
        node = pending.pop()
        if "Scan" in node.nodeName():
            metric = node.metrics().get("numOutputRows")
            total += metric.get().value() if metric.isDefined() else 0
        plan = node.getClass().getSimpleName()
        if plan == "AdaptiveSparkPlanExec":
            pending.append(node.executedPlan())
        elif plan.endswith("QueryStageExec"):
            pending.append(node.plan())
        else:
            children = node.children()
            pending += [children.apply(k) for k in range(children.size())]
    return total


def chat_turns(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Turns of chat texts '[09:35] name: words': row id, turn, minute, speaker, message.

    White space is that of RE2 (a vertical tab is none), as in the queries' SQL, and a mark of time that follows another one on
    its line begins no turn where the white space between them belongs to the mark before.
    """
    cut_up = F.regexp_replace(F.col(text), r"[ \t\f][ \t\n\f\r]*(\[\d\d:\d\d\] )", "\n$1")
    lines = df.select(F.col(row_id), F.posexplode(F.split(cut_up, r"\r\n|\r|\n")).alias("turn", "_line"))
    shape = r"(?s)^[ \t\n\f\r]*\[(\d\d):(\d\d)\] ([^: \t\n\f\r]+): (.*)$"
    part = lambda k: F.regexp_extract("_line", shape, k)
    return lines.where(F.rlike("_line", F.lit(shape))).select(row_id, "turn", (part(1).cast("int") * 60 + part(2).cast("int")).alias("minute"), part(3).alias("speaker"), part(4).alias("message"))


def keyword_screen(turns: DataFrame, dictionary: DataFrame, message: str = "message") -> DataFrame:
    """Turns that hold a phrase of the dictionary (category, phrase) as whole words, whatever the case, one row for each of its phrases.

    Runs of words of a turn are joined with the words of the phrases, so that phrases within phrases are found too; a phrase
    must then stand in the message letter by letter, signs and blanks included. A phrase without any word is never found; nulls
    find nothing and are not found. Only the number of words of the longest phrase reaches the driver.
    """
    terms = dictionary.where("phrase is not null").select("category", F.lower("phrase").alias("phrase")).distinct()
    terms = terms.withColumn("_words", F.array_join(tokens(F.col("phrase")), " ")).where("_words <> ''")
    longest = terms.agg(F.max(F.size(F.split("_words", " ")))).first()[0] or 0
    words = turns.withColumn("_tokens", tokens(F.col(message)))
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.size("_tokens") - n), lambda i: F.array_join(F.slice("_tokens", i + 1, F.lit(n)), " "))
    held = [F.when(F.size("_tokens") >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]
    grams = words.withColumn("_words", F.explode(F.array_distinct(reduce(F.concat, held, F.array().cast("array<string>"))))).drop("_tokens")
    # Quoted, whatever signs it has, and not within longer words.
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])\Q"), F.replace("phrase", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{M}\p{N}])"))
    return grams.join(terms, "_words").where(F.rlike(F.lower(message), quoted)).drop("_words")


def classified(turns: DataFrame, scorer: Callable[[pd.Series], pd.Series], message: str = "message", limit: float = 0.5) -> DataFrame:
    """Turns with ``score`` and ``intent`` ('suspicious' from ``limit`` on, else 'legitimate', null for a null score).

    ``scorer`` is any function from a batch of messages to scores, such as a model's; it runs on Arrow batches.
    """
    scored = turns.withColumn("score", F.pandas_udf(scorer, "double")(F.col(message)))
    return scored.withColumn("intent", F.when(F.col("score") >= limit, "suspicious").when(F.col("score") < limit, "legitimate"))


def with_rules(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits with the rules (category, rule) that apply to their category; hits of a category without rule keep null."""
    return hits.join(rules.select("category", "rule"), "category", "left")


def context_window(turns: DataFrame, conversation: str, hit: Column, before: int = 1, after: int = 1) -> DataFrame:
    """Hits with the messages around them, in order, as ``context``."""
    around = Window.partitionBy(conversation).orderBy("turn").rowsBetween(-before, after)
    return turns.withColumn("context", F.collect_list("message").over(around)).withColumn("_hit", hit).where("_hit").drop("_hit")


def linked_behaviour(turns: DataFrame, conversation: str, first: Column, then: Column) -> DataFrame:
    """Conversations in which a turn of the second kind follows one of the first: conversation, first_turn, then_turn.

    The earliest first turn and the next turn of the second kind after it; one window per conversation, no self-join.
    """
    later = Window.partitionBy(conversation).orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    marked = turns.withColumn("_first", first).withColumn("_then", F.min(F.when(then, F.col("turn"))).over(later))
    return marked.where("_first and _then is not null").groupBy(conversation).agg(F.min(F.struct("turn", "_then")).alias("_x")).select(conversation, F.col("_x.turn").alias("first_turn"), F.col("_x._then").alias("then_turn"))


def novel_terms(turns: DataFrame, flagged: Column, least: int = 5) -> DataFrame:
    """term, flagged_n, total_n, lift of terms that are more frequent in flagged turns than overall."""
    words = turns.select(flagged.alias("_f"), F.explode(tokens(F.col("message"))).alias("term"))
    counts = words.groupBy("term").agg(F.count(F.when(F.col("_f"), True)).alias("flagged_n"), F.count(F.lit(1)).alias("total_n"))
    totals = counts.agg(F.sum("flagged_n").alias("_fn"), F.sum("total_n").alias("_tn"))
    lift = F.try_divide(F.col("flagged_n") / F.col("_fn").cast("double"), F.col("total_n") / F.col("_tn").cast("double"))
    return counts.where(F.col("flagged_n") >= least).crossJoin(F.broadcast(totals)).select("term", "flagged_n", "total_n", lift.alias("lift")).where("lift > 1")

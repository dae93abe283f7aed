"""Retrieval quality against graded truth, and gaps in what the logs know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import query_entities
from tracelake.operators.index import contained
from tracelake.sources.tables import stored

# Words that don't count in matching summaries.
STOP_WORDS = (
    "the", "and", "for", "this", "that", "with", "from", "was", "are", "not", "but", "has", "had", "have", "will", "been",
    "can", "its", "all", "also", "into", "let", "now", "then", "done", "just",
)
ROLE_GRADE = {"primary": 3, "secondary": 2}


def truth_words(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def match_truth(results: DataFrame, events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Results (query_id, doc_id, rank, summary, session) with grade and noise from judged events and sessions.

    The judged event with the largest share of its words in the summary, half at least,
    decides, the first of equals; else a relevant session whose first twelve characters
    meet the result's.  No match leaves nulls.
    """
    truth = events.withColumn("words", truth_words(F.col("summary"))).where(F.size("words") > 0).withColumn("size", F.size("words"))
    t = truth.select("query_id", "place", "size", F.explode("words").alias("word"))
    r = results.select("query_id", "doc_id", F.explode(F.array_distinct(truth_words(F.col("summary")))).alias("word"))
    shared = r.join(t, ["query_id", "word"]).groupBy("query_id", "doc_id", "place").agg((F.count(F.lit(1)) / F.max("size")).alias("share")).where("share >= 0.5")
    best = shared.groupBy("query_id", "doc_id").agg(F.max_by("place", F.struct("share", -F.col("place"))).alias("place"))
    out = results.join(best, ["query_id", "doc_id"], "left").join(events.select("query_id", "place", "grade", "noise"), ["query_id", "place"], "left")
    if sessions is None:
        return out.drop("place")
    grade = F.lit(1)
    for role, g in ROLE_GRADE.items():
        grade = F.when(F.col("role") == role, g).otherwise(grade)
    known = sessions.where("relevant").select("query_id", F.col("session").alias("truth_session"), grade.alias("session_grade"))
    open_rows = out.where(F.col("place").isNull() & (F.coalesce(F.col("session").cast("string"), F.lit("")) != "")).select("query_id", "doc_id", "session")
    a, b = F.col("session").cast("string"), F.col("truth_session").cast("string")
    meets = F.contains(b, F.substring(a, 1, 12)) | F.contains(a, F.substring(b, 1, 12))
    fallback = open_rows.join(known, "query_id").where(meets).groupBy("query_id", "doc_id").agg(F.min_by("session_grade", "truth_session").alias("session_grade"))
    return out.join(fallback, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", "session_grade")).drop("place", "session_grade")


def precision_at(judged: DataFrame, ks: tuple[int, ...] = (5, 10, 20), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Share of relevant rows (grade over 0) among the first k, or all if they are fewer."""
    hits = F.count(F.lit(1))
    found = lambda k: F.count_if((F.col("rank") <= k) & (F.coalesce(F.col("grade"), F.lit(0)) > 0))
    return judged.groupBy(*by).agg(*[F.round(found(k) / F.least(F.lit(k), hits), 6).alias(f"p_at_{k}") for k in ks], hits.alias("hits"))


def session_recall(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """(query_id, found, relevant, recall): relevant sessions that results touch, by their first twelve characters."""
    good = sessions.where("relevant").select("query_id", F.substring(F.col("session").cast("string"), 1, 12).alias("head")).distinct()
    seen = results.select("query_id", F.substring(F.col("session").cast("string"), 1, 12).alias("head")).distinct().withColumn("hit", F.lit(1))
    out = good.join(seen, ["query_id", "head"], "left").groupBy("query_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("relevant"))
    return out.withColumn("recall", F.round(F.col("found") / F.col("relevant"), 6))


def noise_breakdown(judged: DataFrame, n: int = 20) -> DataFrame:
    """(mode, noise, n, rank): labels of irrelevant rows."""
    label = F.coalesce(F.nullif("noise", F.lit("")), F.lit("unlabeled"))
    counted = judged.where(F.coalesce(F.col("grade"), F.lit(0)) == 0).groupBy("mode", label.alias("noise")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("n"), "noise"))).where(F.col("rank") <= n)


def compare_modes(scores: DataFrame) -> DataFrame:
    """Mean precision and recall of each mode."""
    names = [c for c in scores.columns if c.startswith("p_at_") or c == "recall"]
    return scores.groupBy("mode").agg(*[F.round(F.avg(c), 6).alias(c) for c in names], F.count(F.lit(1)).alias("queries"))


def phantoms(queries: DataFrame, results: DataFrame, logs: DataFrame, text: str = "line", within: bool = True) -> DataFrame:
    """(query_id, query, entity): entities of queries without results that no log line (text) holds.

    What is not an entity of any line is looked for `within` the lines too, as a part of
    a longer name.
    """
    empty = queries.join(results.select("query_id").distinct(), "query_id", "left_anti")
    asked = empty.select("query_id", "query", F.explode(query_entities(F.col("query"))).alias("entity"))
    named = logs.select(F.explode(query_entities(F.col(text))).alias("entity")).distinct()
    unnamed = asked.join(named, "entity", "left_anti").select("query_id", "query", "entity")
    if not within:
        return unnamed
    unnamed = stored(unnamed, "unnamed-entities")
    return unnamed.join(contained(logs, text, unnamed, "entity"), "entity", "left_anti").select("query_id", "query", "entity")


def gap_events(found: DataFrame) -> DataFrame:
    """One gap event for each query with unknown entities."""
    out = found.groupBy("query_id", "query").agg(F.array_sort(F.collect_set("entity")).alias("unknown_entities"))
    return out.select(F.concat(F.lit("gap-"), F.col("query_id").cast("string")).alias("event_id"), F.lit("knowledge_gap").alias("type"), "query", "unknown_entities", F.lit(0.6).alias("salience"))

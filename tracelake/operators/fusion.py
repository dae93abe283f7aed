"""Fusing ranked lists and serving results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.classify import clamp_salience, high_signal
from tracelake.functions.times import time_window

DEPTH = 500


def fusion_depth(hits: DataFrame, depth: int = DEPTH, by: tuple[str, ...] = ("query_id",), score: str = "score", key: str = "doc_id") -> DataFrame:
    """The first `depth` rows of each list."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))
    return hits.withColumn("_n", rank).where(F.col("_n") <= depth).drop("_n")


def rrf(lists: dict[str, DataFrame], k: int = 60, weight: str | None = None, depth: int = DEPTH, key: str = "doc_id", digits: int = 9) -> DataFrame:
    """(query_id, key, score, sources): the sum of 1 / (k + rank) over ranked lists (query_id, key, rank).

    `weight` names a salience column that multiplies each term; the largest is kept.
    """
    parts = []
    for i, (name, hits) in enumerate(lists.items()):
        w = clamp_salience(F.col(weight)) if weight else F.lit(1.0)
        parts.append(hits.where(F.col("rank") <= depth).select("query_id", key, (w / (k + F.col("rank"))).alias("part"), w.alias("salience"), F.struct(F.lit(i).alias("at"), F.lit(name).alias("name")).alias("source")))
    union = reduce(lambda a, b: a.unionByName(b), parts)
    sources = F.array_join(F.transform(F.array_sort(F.collect_set("source")), lambda s: s["name"]), "+")
    fused = union.groupBy("query_id", key).agg(F.round(F.sum("part"), digits).alias("score"), sources.alias("sources"), F.max("salience").alias("salience"))
    return fused if weight else fused.drop("salience")


def time_decay(hits: DataFrame, as_of: Column, rate: float = 0.001, ts: str = "ts", digits: int = 6) -> DataFrame:
    """Scores times exp(-rate * hours of age); rows without a time keep theirs, a rate of 0 turns it off."""
    if rate <= 0:
        return hits
    hours = F.greatest(F.lit(0.0), (F.unix_millis(as_of) - F.unix_millis(F.col(ts).cast("timestamp"))) / 3_600_000.0)
    return hits.withColumn("score", F.round(F.when(F.col(ts).isNull(), F.col("score")).otherwise(F.col("score") * F.exp(-rate * hours)), digits))


def cut_tail(hits: DataFrame, ratio: float = 0.1) -> DataFrame:
    """Rows with at least `ratio` of their query's best score."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return hits.join(best, "query_id").where(F.col("score") >= F.col("best") * ratio).drop("best")


def hybrid_search(keyword: DataFrame, semantic: DataFrame, times: DataFrame | None = None, as_of: Column | None = None, since: Column | None = None, before: Column | None = None, rate: float = 0.001, ratio: float = 0.1, floor: float = 0.3) -> DataFrame:
    """(query_id, doc_id, score, sources) from keyword and vector hits (query_id, doc_id, score, rank).

    A query with hits of one kind only keeps their raw scores.  Times (doc_id, ts) serve
    the window, which holds after fusion, and the decay.
    """
    semantic = semantic.where(F.col("score") >= floor)
    fused = rrf({"bm25": keyword, "semantic": semantic})
    has = keyword.select("query_id").distinct().withColumn("k", F.lit(True)).join(semantic.select("query_id").distinct().withColumn("s", F.lit(True)), "query_id", "full")
    raw = keyword.select("query_id", "doc_id", F.col("score").alias("raw")).union(semantic.select("query_id", "doc_id", "score")).groupBy("query_id", "doc_id").agg(F.max("raw").alias("raw"))
    one = F.col("k").isNull() | F.col("s").isNull()
    every = raw.join(fused, ["query_id", "doc_id"], "left").join(has, "query_id")
    only = F.when(F.col("k").isNull(), "semantic").otherwise("bm25")
    out = every.where(one | F.col("score").isNotNull()).select("query_id", "doc_id", F.when(one, F.col("raw")).otherwise(F.col("score")).alias("score"), F.when(one, only).otherwise(F.col("sources")).alias("sources"))
    if times is not None:
        out = time_window(out.join(times, "doc_id", "left"), since, before)
        out = time_decay(out, as_of, rate) if as_of is not None else out
    return cut_tail(out, ratio)


def browse(events: DataFrame, n: int = DEPTH) -> DataFrame:
    """The newest events of each project that carry signal, with the project's total."""
    w = Window.partitionBy("project").orderBy(F.desc("ts"), "event_id")
    good = high_signal(events)
    totals = good.groupBy("project").agg(F.count(F.lit(1)).alias("total"))
    top = good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(totals, "project").withColumn("score", F.lit(0.0)).withColumn("source", F.lit("browse"))


def list_events(events: DataFrame, limit: int = 100, offset: int = 0, project: str | None = None, everything: bool = False) -> tuple[DataFrame, int]:
    """A page of the newest events, 500 at most, and how many there are."""
    rows = events if everything else high_signal(events)
    rows = rows if project is None else rows.where(F.col("project") == project)
    return rows.orderBy(F.col("ts").desc_nulls_last(), "event_id").offset(offset).limit(min(limit, 500)), rows.count()


def focus(events: DataFrame, projects: DataFrame, n: int = 20) -> DataFrame:
    """The latest rows of each kind for a family of projects (project)."""
    mine = events.join(projects.select("project").distinct(), "project", "left_semi")
    return mine.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("ts"), "event_id"))).where(F.col("rank") <= n)


def delta_serve(results: DataFrame, served: DataFrame, last: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results (session_id, key, rank, served_at) not served to their session yet, the history with them, and how many were held back.

    The history keeps the latest `last` keys of a session.
    """
    seen = served.select("session_id", "key").distinct()
    fresh = results.join(seen, ["session_id", "key"], "left_anti")
    both = served.select("session_id", "key", "served_at").unionByName(fresh.select("session_id", "key", "served_at"))
    latest = both.groupBy("session_id", "key").agg(F.max("served_at").alias("served_at"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("served_at"), "key"))
    history = latest.withColumn("n", rank).where(F.col("n") <= last).drop("n")
    held = results.join(seen, ["session_id", "key"], "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("suppressed"))
    return fresh, history, held


def collapse_by_text(results: DataFrame, text: str = "text", keep: int = 120) -> DataFrame:
    """The first result of a query for each display text; rows without text stay."""
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, keep)
    rank = F.row_number().over(Window.partitionBy("query_id", head, F.when(head == "", F.col("doc_id"))).orderBy("rank", "doc_id"))
    return results.withColumn("_n", rank).where(F.col("_n") == 1).drop("_n")


def context_cost(results: DataFrame, text: str = "text", window: int = 200_000) -> DataFrame:
    """(query_id, tokens, percent): what a query's served rows take of a context window."""
    tokens = F.floor(F.sum(F.length(text)) / 4).cast("long")
    return results.groupBy("query_id").agg(tokens.alias("tokens")).withColumn("percent", F.round(F.col("tokens") * 100.0 / window, 4))

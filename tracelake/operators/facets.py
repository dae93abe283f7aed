"""Facet counts, drill-down, and other groupings of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.ordered import deal, running, with_previous

SERVER_TOPS = {"project": 5, "type": 5, "quadrant": 4, "source": 5, "month": 6, "day": 7}
CLI_TOPS = {"project": 8, "type": 8, "source": 1 << 30, "month": 6, "day": 7}
CLI_ROWS = 500
TIME_DIMS = ("month", "day")


def facet_values(results: DataFrame) -> DataFrame:
    """(query_id, doc_id, dim, value): one row for each facet value of a result; compound sources count for each part."""
    c = results.columns
    col = lambda n: F.col(n).cast("string") if n in c else F.lit(None).cast("string")
    ts = F.col("ts").cast("timestamp") if "ts" in c else F.lit(None).cast("timestamp")
    one = lambda dim, v: F.struct(F.lit(dim).alias("dim"), v.alias("value"))
    plain = F.array(one("project", col("project")), one("type", col("type")), one("quadrant", col("quadrant")), one("month", F.date_format(ts, "yyyy-MM")), one("day", F.date_format(ts, "yyyy-MM-dd")))
    parts = F.transform(F.split(col("source"), r"\+"), lambda s: one("source", s))
    both = F.concat(plain, F.coalesce(parts, F.slice(plain, 1, 0)))
    return results.select("query_id", "doc_id", F.explode(both).alias("f")).select("query_id", "doc_id", "f.*").where(F.coalesce(F.col("value"), F.lit("")) != "")


def facets(results: DataFrame, dialect: str = "server") -> DataFrame:
    """(query_id, dim, value, n, rank): the commonest values of each dimension, the latest of months and days.

    The `cli` dialect counts a query's first 500 results (`rank`), knows no quadrants and
    no value "?", lists all sources, and adds `more`, how many values stand below the list.
    """
    if dialect == "cli":
        values = facet_values(results.where(F.col("rank") <= CLI_ROWS)).where(F.col("dim").isin(*CLI_TOPS) & (F.col("value") != "?"))
    else:
        values = facet_values(results)
    counts = values.groupBy("query_id", "dim", "value").agg(F.count(F.lit(1)).alias("n"))
    by_time = F.col("dim").isin(*TIME_DIMS)
    order = [F.when(by_time, F.col("value")).desc_nulls_last(), F.desc("n"), "value"]
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "dim").orderBy(*order)))
    most = F.lit(0)
    for dim, n in (CLI_TOPS if dialect == "cli" else SERVER_TOPS).items():
        most = F.when(F.col("dim") == dim, n).otherwise(most)
    if dialect == "cli":
        values_of = F.max("rank").over(Window.partitionBy("query_id", "dim"))
        ranked = ranked.withColumn("more", F.greatest(values_of - most, F.lit(0)).cast("long"))
    return ranked.where(F.col("rank") <= most)


def facet_span(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count(F.lit(1)).alias("total"))


def drill(results: DataFrame, selections: dict[str, list[str]]) -> DataFrame:
    """Results that match one selected value in every dimension; any part of a compound source counts."""
    for dim, values in selections.items():
        if dim == "source":
            results = results.where(F.arrays_overlap(F.split("source", r"\+"), F.array(*[F.lit(v) for v in values])))
        else:
            results = results.where(F.col(dim).cast("string").isin(*(values[:1] if dim == "quadrant" else values)))
    return results


def live_counts(base: DataFrame, filtered: DataFrame) -> DataFrame:
    """The values of `base` facets with their counts in the filtered results, 0 where none are left."""
    now = facet_values(filtered).groupBy("query_id", "dim", "value").agg(F.count(F.lit(1)).alias("live"))
    return base.join(now, ["query_id", "dim", "value"], "left").withColumn("live", F.coalesce("live", F.lit(0)).cast("long"))


def type_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def projects(events: DataFrame) -> DataFrame:
    return events.select("project").where(F.coalesce(F.col("project").cast("string"), F.lit("")) != "").distinct()


def session_facets(sessions: DataFrame, tops: dict[str, int] | None = None) -> DataFrame:
    """(dim, value, n, rank): sessions by project, events by type, quadrant and commit type (map columns)."""
    tops = tops or {"type_counts": 6, "quadrant_counts": 6, "commit_counts": 4}
    out = sessions.groupBy(F.lit("project").alias("dim"), F.col("project").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    for name in [m for m in tops if m in sessions.columns]:
        each = sessions.select(F.explode(name).alias("value", "c"))
        out = out.union(each.groupBy(F.lit(name).alias("dim"), "value").agg(F.sum("c").alias("n")))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value"))
    most = F.lit(1 << 30)
    for name, n in tops.items():
        most = F.when(F.col("dim") == name, n).otherwise(most)
    return out.withColumn("rank", rank).where(F.col("rank") <= most)


def event_groups(events: DataFrame, key: Column, gap_seconds: int = 300, hot_rows: int | None = None) -> DataFrame:
    """(event_id, group_id): events in time order fall into one group while the key stays and gaps are under `gap_seconds`.

    The order goes over all events, in ranges of about `hot_rows` (`ordered.deal`) that
    are stitched at their edges.  group_id is the first event's id.
    """
    order = ("at", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = deal(events.select(F.lit(0).alias("log"), "event_id", at.alias("at"), F.coalesce(key.cast("string"), F.lit("")).alias("k")), "log", order, hot_rows)
    joined = with_previous(rows, "log", order, ("at", "k"))
    prev = F.col("_prev")
    starts = prev.isNull() | (prev["k"] != F.col("k")) | (F.col("at") - prev["at"] >= gap_seconds * 1_000_000)
    head = F.when(starts, F.struct("at", "event_id"))
    return running(joined.withColumn("_head", head), "log", order, F.col("_head"), "max", "_first").select("event_id", F.col("_first.event_id").alias("group_id"))

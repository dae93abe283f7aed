"""Sessions, interval matching, and the graph of parent events."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.classify import high_signal
from tracelake.functions.text import session_line
from tracelake.operators.ordered import deal, running, with_previous
from tracelake.operators.sweep import first_windows
from tracelake.operators.vectors import _cut
from tracelake.sources.tables import stored

#: Starts of a busy cell that meet in one group, with RUN_SHARE times fewer runs; pairs that one task compares, as long as there are no more than MOST_TASKS.
CHUNK, RUN_SHARE, TASK_PAIRS, MOST_TASKS = 4096, 4, 1 << 24, 20_000
#: Cells of the mean length of a session; sessions of a range of ids, as long as there are no more than MOST_RANGES of them.
CELLS, RANGE_ROWS, MOST_RANGES = 4, 4096, 1024


def seconds(ts: str | Column) -> Column:
    """Seconds of a time with its fraction."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / 1_000_000.0


def segment(events: DataFrame, key: str, gap_seconds: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add segment, from 0 within a key: a new one starts where the gap is over `gap_seconds`."""
    dealt = with_previous(deal(events, key, (ts, tie)), key, (ts, tie), (ts,))
    jump = F.coalesce((seconds(ts) - seconds(F.col(f"_prev.{ts}")) > gap_seconds).cast("long"), F.lit(0))
    return running(dealt.withColumn("_jump", jump), key, (ts, tie), F.col("_jump"), "sum", "segment").drop("_jump", "_prev", "_part")


def counts_map(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    counted = rows.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").groupBy(key, F.col(value).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name))


def session_rollup(events: DataFrame, cutoff: Column | None = None, most_events: int = 200) -> DataFrame:
    """One row for each session of two events or more that ends at `cutoff` or later.

    start, end, n_events, the commonest project, projects, counts by type (and quadrant,
    commit_type), and the first `most_events` telling events.
    """
    c = events.columns
    by_project = events.where(F.col("project").isNotNull()).groupBy("session_id", "project").agg(F.count(F.lit(1)).alias("n"))
    main = by_project.groupBy("session_id").agg(F.max_by("project", F.struct("n", "project")).alias("project"), F.array_sort(F.collect_set("project")).alias("projects"))
    out = events.groupBy("session_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_events")).where("n_events >= 2")
    out = out if cutoff is None else out.where(F.col("end_ts") >= cutoff)
    out = out.join(main, "session_id", "left").join(counts_map(events, "session_id", "type", "type_counts"), "session_id", "left")
    for name in [n for n in ("quadrant", "commit_type") if n in c]:
        out = out.join(counts_map(events, "session_id", name, f"{name}_counts"), "session_id", "left")
    if most_events:
        rank = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
        top = high_signal(events).select("session_id", "ts", "event_id", session_line(c).alias("line")).withColumn("n", rank).where(F.col("n") <= most_events)
        listed = top.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id", "line"))), lambda e: F.struct(e["event_id"].alias("event_id"), e["line"].alias("line"))).alias("events"))
        out = out.join(listed, "session_id", "left")
    return out


def _count_and_mean(rows: DataFrame) -> tuple[int, float]:
    """Number of rows and the mean of hi - lo, a second at least: cells of that width are about two for each row, however long some rows are."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hi") - F.col("lo")).alias("m")).first()
    return r["n"], max(1.0, r["m"] or 1.0)


def session_overlaps(sessions: DataFrame, cell_seconds: float | None = None, by: str | None = None) -> DataFrame:
    """(a, b, overlap_start, overlap_end) of sessions that share time, a < b; touching ends don't count.

    A session meets those that start while it runs: in the cells of time it covers, of a quarter of the
    sessions' mean length by default, with what starts there.  The starts and the runs of a busy cell meet in pairs of
    chunks of about CHUNK and CHUNK / RUN_SHARE, dealt over tasks by the rows they compare and not by their bytes, which say
    little of the pairs they make.  `by` joins only sessions equal in that column.

    A chunk of runs is a range of ids, in order of their ends, and each start meets all of it at once: then but one of a and b
    changes from pair to pair, in an order that comes again with the next start, and the many pairs take few bytes
    where they are written.
    """
    keys, own = ["cell", *([by] if by else [])], [by] if by else []
    whole = stored(sessions.select("session_id", "start_ts", "end_ts", *own), "sessions")
    n, mean = _count_and_mean(whole.select(seconds("start_ts").alias("lo"), seconds("end_ts").alias("hi")))
    ranges = min(MOST_RANGES, math.ceil(n / RANGE_ROWS))
    rows = whole.withColumn("range", F.lit(0)) if ranges < 2 else stored(whole.repartitionByRange(ranges, "session_id").withColumn("range", F.spark_partition_id()), "ranges")
    width = max(1, round((cell_seconds or mean / CELLS) * 1_000_000))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cell = lambda c: F.floor(us(c) / width).cast("long")
    starts, runs = rows.withColumn("cell", cell("start_ts")), rows.withColumn("cell", F.explode(F.sequence(cell("start_ts"), cell("end_ts"))))
    count = lambda side, n, *more: side.groupBy(*keys, *more).agg(F.count(F.lit(1)).alias(n))
    met = count(runs, "n_runs", "range").join(count(starts, "n_starts"), keys)
    before = F.coalesce(F.sum("n_runs").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = max(1, CHUNK // RUN_SHARE)
    bucketed = met.withColumn("bucket", F.floor(before / most).cast("long"))
    parts = F.ceil(F.sum("n_runs").over(Window.partitionBy(*keys, "bucket")) / most).cast("long")  # ids that lie close in time fill a range more than once
    sizes = stored(bucketed.withColumn("parts", parts).withColumn("p", F.ceil(F.col("n_starts") / CHUNK).cast("long")), "cells")
    compared = sizes.agg(F.sum(F.col("n_starts") * F.col("n_runs").cast("double")).alias("n")).first()["n"] or 0.0
    tasks = min(MOST_TASKS, max(1, math.ceil(compared / TASK_PAIRS)))
    number = lambda of: F.pmod(F.xxhash64("session_id", *own), of)
    until = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    place = [*keys, "start_chunk", "bucket", "part"]

    def dealt(side: DataFrame, order: str) -> DataFrame:
        each = side.select(*place, "session_id", "start_ts", "end_ts").repartition(tasks, *place).sortWithinPartitions(*place, order, "session_id")
        return each.withColumn("row", F.monotonically_increasing_id())  # or Spark leaves out the sort before a join

    buckets = sizes.select(*keys, "p", "bucket", "parts").distinct()
    y = dealt(starts.join(buckets, keys).withColumn("start_chunk", number(F.col("p"))).withColumn("part", until("parts")), "start_ts").alias("y")
    x = dealt(runs.join(sizes, [*keys, "range"]).withColumn("part", number(F.col("parts"))).withColumn("start_chunk", until("p")), "end_ts").alias("x")
    same = functools.reduce(Column.__and__, [F.col(f"y.{k}") == F.col(f"x.{k}") for k in place])
    kept = (F.col("x.row") >= 0) & (F.col("y.row") >= 0)
    first = (us("x.start_ts") < us("y.start_ts")) | ((us("x.start_ts") == us("y.start_ts")) & (F.col("x.session_id") < F.col("y.session_id")))
    meets = same & kept & first & (us("y.start_ts") < us("x.end_ts")) & (us("x.start_ts") < us("y.end_ts")) & (F.col("x.session_id") != F.col("y.session_id"))
    return y.join(x, meets).select(F.least("x.session_id", "y.session_id").alias("a"), F.greatest("x.session_id", "y.session_id").alias("b"), F.col("y.start_ts").alias("overlap_start"), F.least("x.end_ts", "y.end_ts").alias("overlap_end"))


def attach_orphans(commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """(event_id, session_id) of commits without a session inside one that has their project; the newest start wins."""
    inside = first_windows(commits.select("event_id", "ts", "project"), sessions, latest=True, any_project=False)
    return inside.groupBy("event_id").agg(F.max_by("session_id", F.struct("start_us", "session_id")).alias("session_id"))


def enrich_sessions(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events with session_id filled in where a window holds them, and `matched` saying how.

    A window with the event's project comes first, then the earliest start.  Memory
    events are left alone.
    """
    missing = F.col("session_id").isNull() & ~F.coalesce(F.col("type").startswith("memory_"), F.lit(False))
    inside = first_windows(events.where(missing).select("event_id", "ts", "project"), windows)
    best = inside.groupBy("event_id").agg(F.min_by(F.struct("session_id", "same"), F.struct(~F.col("same"), "start_us", "session_id")).alias("m"))
    out = events.join(best, "event_id", "left")
    how = F.when(F.col("session_id").isNotNull(), "own").when(F.col("m").isNull(), "none").when(F.col("m.same"), "project").otherwise("time")
    return out.withColumn("matched", how).withColumn("session_id", F.coalesce("session_id", F.col("m.session_id"))).drop("m")


def session_windows(events: DataFrame, transcript_times: DataFrame | None = None) -> DataFrame:
    """(session_id, start_ts, end_ts, projects) from events, widened by transcripts (session_id, ts, project)."""
    rows = events.where("session_id is not null").select("session_id", "ts", "project")
    rows = rows if transcript_times is None else rows.unionByName(transcript_times.select("session_id", "ts", "project"))
    return rows.groupBy("session_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.array_sort(F.collect_set("project")).alias("projects"))


def work_segments(events: DataFrame, gap_seconds: float = 900, key: str = "session_id") -> DataFrame:
    """(key, segment, start_ts, end_ts, n_events): stretches of a session without a gap over `gap_seconds`."""
    return segment(events, key, gap_seconds).groupBy(key, "segment").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_events"))


def legacy_sessions(events: DataFrame) -> DataFrame:
    """Events without a known session get one named after their project and day."""
    unknown = F.coalesce(F.col("session_id").cast("string"), F.lit("")).isin("", "unknown")
    name = F.concat(F.lit("Legacy: "), F.coalesce(F.col("project").cast("string"), F.lit("unknown")), F.lit(" ("), F.date_format("ts", "yyyy-MM-dd"), F.lit(")"))
    return events.withColumn("session_id", F.when(unknown, name).otherwise(F.col("session_id").cast("string")))


def related(events: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, event_id): events whose related_ids hold an id of `ids` (id)."""
    return events.select("event_id", F.explode("related_ids").alias("id")).join(ids, "id").select("id", "event_id").distinct()


def session_event_count(events: DataFrame) -> DataFrame:
    """Add n_so_far: a session's events up to each one."""
    order = ("ts", "event_id")
    return running(deal(events, "session_id", order), "session_id", order, F.lit(1), "sum", "n_so_far").drop("_part")


def with_ordinal(events: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add ordinal, the place in time order over all rows, without one task that sees them all."""
    dealt = _cut(events.repartitionByRange(F.col(ts), F.col(tie)).sortWithinPartitions(ts, tie).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each partition
    return dealt.join(starts, "_part").withColumn("ordinal", (F.col("_before") + F.col("_id") - F.col("_first")).cast("long")).drop("_part", "_id", "_first", "_n", "_before")


def link_parents(events: DataFrame, window_seconds: float = 60, mode: str = "session", key: str = "session_id") -> DataFrame:
    """(event_id, parent_event_id): the event before, at most `window_seconds` earlier, of the same session.

    `session` looks back within the session; `log_tail` takes the line before in the
    whole log, if it is of that session.
    """
    if mode == "session":
        order = ("ts", "event_id")
        rows = with_previous(deal(events.select("event_id", "ts", key), key, order), key, order, ("event_id", "ts"), "p")
    else:
        rows = with_ordinal(events.select("event_id", "ts", key))
        before = rows.select((F.col("ordinal") + 1).alias("ordinal"), F.col(key).alias("pk"), F.struct("event_id", "ts").alias("p"))
        rows = rows.join(before, "ordinal").where(F.col("pk") == F.col(key))
    gap = seconds("ts") - seconds(F.col("p.ts"))
    return rows.where((gap >= 0) & (gap <= window_seconds)).select("event_id", F.col("p.event_id").alias("parent_event_id"))


def thread(edges: DataFrame, starts: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(start_id, event_id, role) of the ancestors and descendants of each start in a parent graph (event_id, parent_event_id).

    Chains may be of any length: each round doubles the steps, up and down from the
    start only.  Starts that are their own ancestors go step by step instead; there an
    event already in the arc ends its branch, so cycles end.
    """
    begin = _cut(starts.select(F.col("event_id").alias("start_id"), "event_id").distinct())
    up, loops = _reach(begin, edges, "event_id", "parent_event_id")
    open_ended = begin.join(loops, "start_id", "left_anti")
    ups = up.join(loops, "start_id", "left_anti")
    downs, _ = _reach(_cut(open_ended), edges, "parent_event_id", "event_id")
    arc = open_ended.select("start_id", "event_id", F.lit("start").alias("role")).union(ups.withColumn("role", F.lit("ancestor"))).union(downs.withColumn("role", F.lit("descendant")))
    if loops.limit(1).count():
        arc = arc.union(_steps(edges, loops.select(F.col("start_id").alias("event_id"))))
    return arc if events is None else arc.join(events, "event_id")


def _reach(begin: DataFrame, edges: DataFrame, here: str, there: str) -> tuple[DataFrame, DataFrame]:
    """(start_id, event_id) of what each start reaches besides itself, and (start_id) of the starts that reach themselves."""
    jump = _cut(edges.where("parent_event_id is not null").select(F.col(here).alias("from_id"), F.col(there).alias("to_id")).distinct())
    found, loops = begin, []
    while True:  # `found` holds all within less than 2^round steps, `jump` takes 2^round
        met = _cut(found.withColumnRenamed("event_id", "from_id").join(jump, "from_id").select("start_id", F.col("to_id").alias("event_id")).distinct())
        loops.append(met.where("start_id = event_id").select("start_id"))
        new = _cut(met.join(found, ["start_id", "event_id"], "left_anti"))
        if not new.limit(1).count():
            back = functools.reduce(DataFrame.union, loops).distinct()
            return found.where("start_id <> event_id"), _cut(back)
        found = _cut(found.union(new))
        jump = _cut(jump.alias("x").join(jump.alias("y"), F.col("x.to_id") == F.col("y.from_id")).select("x.from_id", "y.to_id").distinct())


def _steps(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The same arcs by frontiers of one step, until they are empty."""
    arc = _cut(starts.select(F.col("event_id").alias("start_id"), "event_id", F.lit("start").alias("role")))
    for role, here, there in (("ancestor", "event_id", "parent_event_id"), ("descendant", "parent_event_id", "event_id")):
        step = edges.where("parent_event_id is not null").select(F.col(here).alias("from_id"), F.col(there).alias("event_id"))
        front = starts.select(F.col("event_id").alias("start_id"), F.col("event_id").alias("from_id"))
        while True:
            new = front.join(step, "from_id").select("start_id", "event_id").distinct().join(arc.select("start_id", "event_id"), ["start_id", "event_id"], "left_anti")
            new = _cut(new)
            if not new.limit(1).count():
                break
            arc = _cut(arc.union(new.withColumn("role", F.lit(role))))
            front = new.withColumnRenamed("event_id", "from_id")
    return arc


def context_gauge(summary: DataFrame, compactions: DataFrame, window: int = 1_000_000) -> DataFrame:
    """(session_id, total_tokens, windows, band): tokens before compactions and of the current phase against a context window."""
    past = compactions.groupBy("session_id").agg(F.sum("pre_tokens").alias("past"))
    out = summary.join(past, "session_id", "left").withColumn("total_tokens", F.coalesce("past", F.lit(0)) + F.coalesce("context_tokens", F.lit(0)))
    load = F.col("total_tokens") / window
    band = F.when(load < 0.15, "light").when(load < 0.5, "moderate").when(load < 1.5, "heavy").otherwise("extreme")
    return out.select("session_id", "total_tokens", F.round(load, 6).alias("windows"), band.alias("band"))


def phase_splits(summary: DataFrame, compactions: DataFrame) -> DataFrame:
    """(session_id, phase, share): how much of a session's tokens lie in its phases up to each compaction, for a gauge's dividers.

    Phases are the compactions with tokens before them and the current phase of `summary`.
    """
    past = compactions.where("pre_tokens > 0").select("session_id", "phase", F.col("pre_tokens").cast("double").alias("tokens"))
    total = past.groupBy("session_id").agg(F.sum("tokens").alias("past")).join(summary.select("session_id", F.coalesce("context_tokens", F.lit(0)).alias("now")), "session_id", "left")
    running = F.sum("tokens").over(Window.partitionBy("session_id").orderBy("phase").rowsBetween(Window.unboundedPreceding, 0))
    shares = past.withColumn("running", running).join(total, "session_id")
    return shares.select("session_id", "phase", F.round(F.col("running") / (F.col("past") + F.coalesce("now", F.lit(0))), 6).alias("share"))

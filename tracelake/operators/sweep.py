"""Which windows of time hold an event: the earliest or latest of them, by a sweep over ranges of time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Times (of events, starts and ends) of a range, as long as there are no more than MOST_RANGES of them.
RANGE, MOST_RANGES = 1 << 18, 20_000
NODE = 1 << 32
FOR_EVER = (1 << 63) - 1


def _bounds(times: DataFrame, per_range: int) -> np.ndarray:
    """Times that cut all times into ranges of about `per_range`; a time that fills several ranges comes several times."""
    ranges = min(MOST_RANGES, -(-times.count() // per_range))
    if ranges == 0:
        return np.array([], np.int64)
    share = [i / ranges for i in range(ranges + 1)]
    return np.array(times.withColumn("at", F.col("at").cast("double")).approxQuantile("at", share, 1 / (4 * ranges))).astype(np.int64)


def _nodes(low: int, high: int) -> list[int]:
    """Dyadic blocks, at most two of a size, that make up low..high: size's logarithm times NODE plus number."""
    out, level = [], 0
    while low <= high:
        if low & 1:
            out.append(level * NODE + low)
            low += 1
        if not high & 1:
            out.append(level * NODE + high)
            high -= 1
        low, high, level = low >> 1, high >> 1, level + 1
    return out


def first_windows(events: DataFrame, windows: DataFrame, latest: bool = False, any_project: bool = True, per_range: int = RANGE) -> DataFrame:
    """(event_id, session_id, same, start_us): of the windows that hold an event, ends included, one.

    Windows (session_id, start_ts, end_ts, projects) with the event's project come first
    (`same`), others only with `any_project`; of these the earliest start, then the smallest session_id wins, or with
    `latest` the latest and largest.  Events (event_id, ts, project) that no such window holds have no row;
    rows without a time match nothing; a null project equals none.

    Time is cut at quantiles u of all times into stretches between two cuts and the cuts
    themselves, a cut that many rows share into several parts.  A window that starts or ends
    inside a stretch is sent there; there are no more of these than the stretch has times.  Of the
    windows that cover all of a stretch only the winner of each project can matter: they are
    reduced on dyadic blocks of stretches before anything is sent, so a long window costs a
    logarithmic number of rows, not one for each cell of time.
    """
    kind = windows.schema["session_id"].dataType.simpleString()
    own = events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("project").cast("string").alias("project")).where("at is not null")
    spans = windows.select("session_id", F.unix_micros(F.col("start_ts").cast("timestamp")).alias("at"), F.unix_micros(F.col("end_ts").cast("timestamp")).alias("until"), F.coalesce(F.col("projects").cast("array<string>"), F.array().cast("array<string>")).alias("projects")).where("at <= until")
    cuts, parts = np.unique(_bounds(own.select("at").union(spans.select("at")).union(spans.select("until")), per_range), return_counts=True)
    sizes = np.ones(2 * len(cuts) + 1, np.int64)
    sizes[1::2] = parts  # stretch 2i ends before cut i, which is stretch 2i + 1
    firsts = np.concatenate([[0], np.cumsum(sizes)])

    @F.pandas_udf("int")
    def place(at: pd.Series, salt: pd.Series) -> pd.Series:
        left, right = np.searchsorted(cuts, at, "left"), np.searchsorted(cuts, at, "right")
        stretch = left + right
        return pd.Series(firsts[stretch] + np.asarray(salt) % sizes[stretch])

    @F.pandas_udf("array<int>")
    def inside(at: pd.Series, until: pd.Series) -> pd.Series:
        ends = [np.searchsorted(cuts, x, "left") + np.searchsorted(cuts, x, "right") for x in (at, until)]
        return pd.Series([sorted({int(firsts[x]) for x in pair if x % 2 == 0}) for pair in zip(*ends, strict=True)])

    @F.pandas_udf("array<long>")
    def covered(at: pd.Series, until: pd.Series) -> pd.Series:
        lows, highs = 2 * np.searchsorted(cuts, at, "left") + 1, 2 * np.searchsorted(cuts, until, "right") - 1
        return pd.Series([_nodes(int(x), int(y)) for x, y in zip(lows, highs, strict=True)])

    @F.pandas_udf("array<int>")
    def unfold(node: pd.Series) -> pd.Series:
        level, number = np.asarray(node) // NODE, np.asarray(node) % NODE
        return pd.Series([list(range(int(firsts[n << x]), int(firsts[(n + 1) << x]))) for x, n in zip(level, number, strict=True)])

    best = F.max if latest else F.min
    nothing, text = F.lit(None), F.array().cast("array<string>")
    blocks = spans.select("session_id", "at", "projects", F.explode(covered("at", "until")).alias("node"))
    named = blocks.select("node", F.explode("projects").alias("name"), "at", "session_id").where("name is not null")
    named = named.groupBy("node", "name").agg(best(F.struct("at", "session_id")).alias("w")).select("node", F.array("name").alias("projects"), F.lit(False).alias("open"), "w")
    if any_project:
        whole = blocks.groupBy("node").agg(best(F.struct("at", "session_id")).alias("w"))
        named = named.unionByName(whole.select("node", text.alias("projects"), F.lit(True).alias("open"), "w"))
    columns = ["part", "at", "kind", "session_id", "until", "projects", "open", "event_id", "project"]
    event = lambda c: nothing.cast(own.schema[c].dataType).alias(c)
    long = named.select(F.explode(unfold("node")).alias("part"), F.col("w.at").alias("at"), F.lit(0).alias("kind"), F.col("w.session_id").alias("session_id"), F.lit(FOR_EVER).alias("until"), "projects", "open", event("event_id"), event("project"))
    short = spans.select(F.explode(inside("at", "until")).alias("part"), "at", F.lit(0).alias("kind"), "session_id", "until", "projects", F.lit(any_project).alias("open"), event("event_id"), event("project"))
    asked = own.select(place("at", F.pmod(F.xxhash64("event_id"), F.lit(1 << 30))).alias("part"), "at", F.lit(1).alias("kind"), nothing.cast(kind).alias("session_id"), F.lit(0).cast("long").alias("until"), text.alias("projects"), F.lit(False).alias("open"), "event_id", "project")
    rows = long.select(*columns).union(short.select(*columns)).union(asked.select(*columns))
    dealt = rows.repartitionById(int(firsts[-1]), F.col("part")).sortWithinPartitions("part", "at", "kind", "session_id")
    sign = -1 if latest else 1

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, by_project, every = None, 0, {}, []
        for pdf in batches:
            out = []
            for number, at, is_event, session, until, projects, opened, event_id, project in zip(*(pdf[c] for c in columns), strict=True):
                if number != part:
                    part, seen, by_project, every = number, 0, {}, []
                if not is_event:
                    seen += 1
                    window = (sign * seen, until, session, at)  # windows come in order of start and id
                    for name in set(projects) - {None}:
                        heapq.heappush(by_project.setdefault(name, []), window)
                    if opened:
                        heapq.heappush(every, window)
                    continue
                same = _holding(by_project.get(project), at)
                found = same or _holding(every, at)
                if found:
                    out.append((event_id, found[2], same is not None, found[3]))
            yield pd.DataFrame(out, columns=["event_id", "session_id", "same", "start_us"])

    return dealt.mapInPandas(sweep, f"event_id {own.schema['event_id'].dataType.simpleString()}, session_id {kind}, same boolean, start_us long")


def _holding(windows: list | None, at: int):
    """The first window that has not ended; those that have are taken away for good, as events come in order of time."""
    while windows and windows[0][1] < at:
        heapq.heappop(windows)
    return windows[0] if windows else None

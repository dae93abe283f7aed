"""The batch operators on streams: feeds, a growing index, parents, serving, novelty, segments, live state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracelake.functions.classify import high_signal
from tracelake.operators.index import Index, Segment, build_index
from tracelake.operators.vectors import novelty_gate
from tracelake.sources.batches import read_batches, write_batch, writer
from tracelake.sources.logs import EVENT_FIELDS, dual_batch, new_only
from tracelake.sources.tables import exists, subfolders

WATERMARK = "10 minutes"


def stream_logs(spark: SparkSession, folder: str, fields: str = EVENT_FIELDS, files_per_batch: int = 100) -> DataFrame:
    """Lines of the log files that arrive in a folder, oldest file first; malformed lines are skipped."""
    reader = spark.readStream.schema(fields).option("mode", "DROPMALFORMED").option("latestFirst", "false")
    return reader.option("maxFilesPerTrigger", files_per_batch).json(folder)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Feed everything there is to `sink` batch by batch; a restart goes on after the last batch done."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def appender(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each batch to a table, once however often the batch comes; `read_batches` reads the table.

    What is there is not looked at: a batch that comes again takes its own folder's place.
    """
    return lambda batch, number: write_batch(batch, path, number)


def dual_appender(domain_path: str, unified_path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a domain table and, as its common fields, to the unified table."""
    return lambda batch, number: dual_batch(batch, domain_path, unified_path, number)


def live_feed(stream: DataFrame) -> DataFrame:
    """Telling events as they arrive."""
    return high_signal(stream)


def stream_dedupe(stream: DataFrame, key: str = "event_id", ts: str = "ts", within: str | None = None) -> DataFrame:
    """Events whose id came before are dropped, however long ago; with `within`, ids are forgotten once the watermark is that far past them."""
    if within is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def index_sink(path: str, text: str = "text") -> Callable[[DataFrame, int], None]:
    """A sink that adds each batch to an index as a segment of its own, named by the batch's number.

    Of what is there only the documents' tables are read, all at once, and texts are met with them only where an
    id came before.  A batch that comes again writes its segment anew, from the documents of the other segments before it.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark, own, docs = batch.sparkSession, f"{path}/segment-{number:012d}", batch
        before = [f"{s.path}/docs" for s in read_index(spark, path).segments if s.path.rsplit("/", 1)[-1] < own.rsplit("/", 1)[-1]]
        if before:
            known = spark.read.parquet(*before).select("doc_id")
            if batch.select("doc_id").join(known, "doc_id", "left_semi").limit(1).count():
                docs = batch.join(known, "doc_id", "left_anti")
        build_index(docs, text, path=own)

    return sink


def read_index(spark: SparkSession, path: str) -> Index:
    """The finished segments at a path; the documents' table is written last."""
    return Index(tuple(Segment(spark, p) for p in subfolders(spark, path) if exists(spark, f"{p}/docs/_SUCCESS")))


def novelty_sink(path: str, reject: float = 0.85, refine: float = 0.70) -> Callable[[DataFrame, int], None]:
    """A sink that stores vectors (vec_id, embedding) that no vector stored before repeats, nor one of smaller id taken from the same batch.

    A batch is compared with what other batches stored, so one that comes again gives the same rows.
    """

    def sink(batch: DataFrame, number: int) -> None:
        old = read_batches(batch.sparkSession, path, but=(writer(batch.sparkSession), number))
        fresh = batch if old is None else new_only(batch, old, "vec_id")
        verdict = novelty_gate(fresh, batch.limit(0) if old is None else old, reject, refine, "greedy")
        write_batch(fresh.join(verdict.where("verdict <> 'duplicate'").select("vec_id"), "vec_id", "left_semi"), path, number)

    return sink


def stream_segments(stream: DataFrame, gap: str = "15 minutes", key: str = "session_id", ts: str = "ts") -> DataFrame:
    """(key, start_ts, end_ts, n_events) of stretches of activity, emitted once the watermark has passed them."""
    windows = stream.withWatermark(ts, WATERMARK).groupBy(F.session_window(ts, gap).alias("w"), key)
    return windows.agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")).select(key, "start_ts", "end_ts", "n_events")


def end_after(handle: StatefulProcessorHandle, millis: int) -> None:
    """Let a key's state expire at a time of the watermark, and at no other."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(millis)


class ParentProcessor(StatefulProcessor):
    """Parent of each event: the one before in its session, if it is near enough in time.

    With `ends`, a session's state goes once the watermark says that no event can have its last one as parent.
    """

    def __init__(self, window_seconds: float, ends: bool = False):
        self.window_seconds, self.ends = window_seconds, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id string, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "event_id"])
        before_id, before_at = self.last.get() if self.last.exists() else (None, None)
        out = []
        for event_id, at in zip(pdf["event_id"], pdf["at"], strict=True):
            near = before_id is not None and 0 <= at - before_at <= self.window_seconds
            out.append((event_id, before_id if near else None))
            before_id, before_at = event_id, at
        self.last.update((before_id, float(before_at)))
        if self.ends:
            end_after(self.handle, int((before_at + self.window_seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["event_id", "parent_event_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_parents(stream: DataFrame, window_seconds: float = 60, key: str = "session_id", watermark: str | None = None) -> DataFrame:
    """(event_id, parent_event_id) as events arrive; batches are taken to follow each other in time.

    With a watermark, such as "10 minutes", the state of a session ends when the watermark is
    `window_seconds` past its last event, and events behind the watermark have no row: a batch
    (`link_parents`) has to take them.  Without one all sessions are kept and all events have a row.
    """
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).alias("at")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", watermark) if watermark else timed
    rows = timed.select(F.col(key).cast("string").alias("key"), F.col("event_id").cast("string").alias("event_id"), at, *(["ts"] if watermark else []))
    mode = "EventTime" if watermark else "None"
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=ParentProcessor(window_seconds, bool(watermark)), outputStructType="event_id string, parent_event_id string", outputMode="Append", timeMode=mode)


class ServeProcessor(StatefulProcessor):
    """Results that a session has not been served lately."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.served = handle.getListState("served", "key string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        served = [k for (k,) in self.served.get()] if self.served.exists() else []
        known, out = set(served), []
        for pdf in rows:
            for k in pdf["key"]:
                if k not in known:
                    known.add(k)
                    served.append(k)
                    out.append((key[0], k))
        if served:
            self.served.put([(k,) for k in served[-self.last :]])
        yield pd.DataFrame(out, columns=["session_id", "key"])

    def close(self) -> None:
        pass


def stream_delta_serving(stream: DataFrame, last: int = 200) -> DataFrame:
    """(session_id, key) of results not served to their session among its latest `last` keys."""
    rows = stream.select(F.col("session_id").cast("string").alias("session_id"), F.col("key").cast("string").alias("key"))
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=ServeProcessor(last), outputStructType="session_id string, key string", outputMode="Append", timeMode="None")


class OngoingProcessor(StatefulProcessor):
    """Whether the last activity of a session follows its last ending.

    With `idle_seconds`, a session's state goes once the watermark is that far past its last row.
    """

    def __init__(self, idle_seconds: float | None = None):
        self.idle_seconds = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "ending long, activity long, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        ending, activity, at = self.state.get() if self.state.exists() else (-1, -1, 0.0)
        for pdf in rows:
            at = max(at, float(pdf["at"].max()))
            for place, kind in zip(pdf["place"], pdf["kind"], strict=True):
                if kind == "ending":
                    ending = max(ending, int(place))
                elif kind == "activity":
                    activity = max(activity, int(place))
        self.state.update((ending, activity, at))
        if self.idle_seconds is not None:
            end_after(self.handle, int((at + self.idle_seconds) * 1000) + 1)
        yield pd.DataFrame([(key[0], activity > ending)], columns=["session_id", "ongoing"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_ongoing(stream: DataFrame, watermark: str | None = None, idle_seconds: float = 3600) -> DataFrame:
    """(session_id, ongoing) after each batch of activities (session_id, place, kind: ending or activity).

    With a watermark, such as "10 minutes", rows have a time (ts): a session without rows for
    `idle_seconds` of the watermark is forgotten, and rows behind the watermark or without a time
    are left out.  What comes after counts as a new session.  Without one all sessions are kept.
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else stream
    at = F.unix_micros("ts") / 1_000_000.0 if watermark else F.lit(0.0)
    timed = timed.where("ts is not null") if watermark else timed
    rows = timed.select(F.col("session_id").cast("string").alias("session_id"), F.col("place").cast("long").alias("place"), "kind", at.alias("at"), *(["ts"] if watermark else []))
    processor = OngoingProcessor(idle_seconds if watermark else None)
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType="session_id string, ongoing boolean", outputMode="Update", timeMode="EventTime" if watermark else "None")

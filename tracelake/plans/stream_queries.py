"""The streaming operators over the given tables: all that is there is fed through, and the sink's table is the result."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans import adapters as ad
from tracelake.plans.catalogue import query
from tracelake.plans.log_queries import pick, sql_pick
from tracelake.plans.search_queries import INDEX
from tracelake.sources.batches import read_batches, write_batch
from tracelake.sources.tables import new_path
from tracelake.streaming import late, tail
from tracelake.streaming import streams as st

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
TYPES = ["note", "bridge_ping_sent", "search", "bridge_ping_received", "fetch"]
FEED = f"e AS (SELECT event_id, ts, user_id, event_type, {sql_pick(TYPES, 'event_id')} AS type FROM events)"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    return spark.readStream.schema(ad.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def batches(spark: SparkSession, sf_dir: str, name: str, key: str, n: int = 4) -> DataFrame:
    """A given table as a stream of n batches, dealt by the key."""
    path, rows = new_path(spark, "stream-in"), ad.table(spark, sf_dir, name)
    for part in range(n):
        dealt = F.pmod(F.xxhash64(F.lit("batch"), key), F.lit(n))  # not the hash of the key alone, by which operators deal a batch again
        rows.where(dealt == part).write.mode("append").parquet(f"{path}/part={part}")
    files = len(spark.read.schema(rows.schema).parquet(f"{path}/part=*").inputFiles())  # more than n where the table is read in several tasks
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // n))).parquet(f"{path}/part=*")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", "ts", "user_id", "event_type", pick(TYPES, "event_id").alias("type"))


def run(frame: DataFrame, sink=None, mode: str = "append", path: str | None = None, keyed: bool = False) -> DataFrame:
    """What a sink, or a plain table, holds once all input is through; `keyed` as `transformWithState` needs it."""
    spark = frame.sparkSession
    path = path or new_path(spark, "stream-out")
    with keyed_state(spark) if keyed else nullcontext():
        st.run_available(frame, sink or st.appender(path), new_path(spark, "stream-state"), mode).awaitTermination()
    return read_batches(spark, path)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within, queries start with state of single keys; the session's own setting comes back."""
    kept = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if kept is None else spark.conf.set(PROVIDER, kept)


@query(f"WITH {FEED} SELECT event_id, type FROM e WHERE type NOT LIKE 'bridge_ping%'")
def stream_live_feed(spark, sf_dir):
    return run(st.live_feed(feed(spark, sf_dir)).select("event_id", "type"))


@query("SELECT event_id, event_type FROM events")
def stream_logs_once(spark, sf_dir):
    """The events' lines written twice, read as a stream of files, each id once."""
    path = new_path(spark, "stream-log")
    e = ad.table(spark, sf_dir, "events")
    lines = e.select(F.to_json(F.struct(F.col("event_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), "event_type")).alias("value"))
    lines.union(lines).write.text(path)
    events = st.stream_logs(spark, path, "event_id long, ts timestamp, event_type string")
    return run(st.stream_dedupe(events).select("event_id", "event_type"))


@query("SELECT event_id, event_type FROM events")
def stream_tailed_logs(spark, sf_dir):
    """The events' lines in logs that are read as far as they go, added to, and read on from where the first run stopped."""
    path, out, state = (new_path(spark, f"tail-{name}") for name in ("log", "out", "state"))
    e = ad.table(spark, sf_dir, "events")
    for part in range(2):
        own = e.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part)
        own.select(F.to_json(F.struct("event_id", "event_type")).alias("value")).write.mode("append").text(path)
        st.run_available(tail.tail_events(spark, tail_root(path), "event_id long, event_type string", suffix=".txt"), st.appender(out), state).awaitTermination()
    return read_batches(spark, out)


@query("SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS session_id, value FROM events")
def stream_dual_written(spark, sf_dir):
    """Events with some sent twice, fed in four batches to a domain and a unified table, then once more after a restart; the two tables side by side."""
    domain, unified, state = (new_path(spark, f"dual-{name}") for name in ("domain", "unified", "state"))
    events = batches(spark, sf_dir, "events", "event_id").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("session_id"), "value")
    again = events.withColumn("copy", F.explode(F.when(F.col("event_id") % 3 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    for _ in range(2):
        st.run_available(st.stream_dedupe(again), st.dual_appender(domain, unified), state).awaitTermination()
    common = read_batches(spark, unified).select(F.col("event_id").cast("long").alias("event_id"), "type", "session_id")
    return common.join(read_batches(spark, domain).select("event_id", "value"), "event_id", "full")


def tail_root(path: str) -> str:
    """A local folder by its plain name, as pyarrow takes it; other addresses as they are."""
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


@query(f"WITH {INDEX} SELECT term, doc_id, tf FROM p")
def stream_index(spark, sf_dir):
    path = new_path(spark, "stream-index")
    st.run_available(batches(spark, sf_dir, "documents", "doc_id").select("doc_id", "text"), st.index_sink(path), new_path(spark, "stream-state")).awaitTermination()
    return st.read_index(spark, path).postings


@query("""WITH l AS (SELECT event_id, lag(event_id) OVER w AS before, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN gap <= 3600000000 THEN before END AS parent_event_id FROM l""")
def stream_parents(spark, sf_dir):
    found = run(st.stream_parents(feed(spark, sf_dir), ad.PARENT_WINDOW, "user_id"), keyed=True)
    return found.select(F.col("event_id").cast("long").alias("event_id"), F.col("parent_event_id").cast("long").alias("parent_event_id"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, event_type AS key FROM events")
def stream_delta_serving(spark, sf_dir):
    """Kinds of events that a user has not seen before."""
    return run(st.stream_delta_serving(feed(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"))), keyed=True)


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, coalesce(max(event_id) FILTER (WHERE event_type = 'click'), -1) > coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), -1) AS ongoing FROM events GROUP BY user_id")
def stream_ongoing(spark, sf_dir):
    """Whether a user clicked after the last purchase; of a user's states the last counts."""
    kind = F.when(F.col("event_type") == "purchase", "ending").when(F.col("event_type") == "click", "activity")
    rows = feed(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("place"), kind.alias("kind"))
    path = new_path(spark, "stream-ongoing")
    numbered = lambda batch, number: write_batch(batch.withColumn("batch", F.lit(number)), path, number)
    return run(st.stream_ongoing(rows), numbered, "update", path, keyed=True).groupBy("session_id").agg(F.max_by("ongoing", "batch").alias("ongoing"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 900000000 THEN 0 ELSE 1 END AS jump FROM events),
s AS (SELECT user_id, ts, sum(jump) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, k
HAVING epoch_us(max(ts)) + 900000000 <= ((SELECT max(epoch_us(ts)) FROM events) // 1000) * 1000 - 600000000""")
def stream_segments(spark, sf_dir):
    """Stretches of activity that the watermark has passed."""
    found = run(st.stream_segments(feed(spark, sf_dir), key="user_id"))
    return found.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n_events")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 900000000 THEN 0 ELSE 1 END AS jump FROM events),
s AS (SELECT user_id, ts, sum(jump) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, k""")
def stream_segments_late(spark, sf_dir):
    """Stretches of activity of events that come in four batches out of order of time, most of them late."""
    path = new_path(spark, "stream-segments")
    rows = batches(spark, sf_dir, "events", "event_id").select("user_id", "ts")
    st.run_available(rows, late.segment_sink(path, "user_id"), new_path(spark, "stream-state")).awaitTermination()
    found = late.segments_with_late(spark, path, "user_id")
    return found.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n_events")


@query()
def stream_novelty(spark, sf_dir):
    """Vectors that no vector of smaller id, kept before them, repeats."""
    path = new_path(spark, "stream-novelty")
    return run(stream(spark, sf_dir, "embeddings").select("vec_id", "embedding"), st.novelty_sink(path, 0.35, 0.25), path=path).select("vec_id")

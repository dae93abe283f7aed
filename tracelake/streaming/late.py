"""Stretches of activity on a stream whose late rows are kept aside and stitched in by a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.sessions import seconds
from tracelake.sources.batches import batch_path, last_batches, read_batches, write_batch, writer
from tracelake.sources.tables import exists, remove


def stitched(parts: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """(key, start_ts, end_ts, n_events): parts of a key without a gap over `gap_seconds` between them become one; single rows are parts too."""
    w = Window.partitionBy(key).orderBy("start_ts", "end_ts")
    reach = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    jumped = parts.withColumn("jump", F.coalesce((seconds("start_ts") - seconds(reach) > gap_seconds).cast("int"), F.lit(0)))
    numbered = jumped.withColumn("segment", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "segment").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n_events").alias("n_events")).drop("segment")


def segment_sink(path: str, key: str = "session_id", ts: str = "ts", gap_seconds: float = 900, delay_seconds: float = 600) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the stretches of activity of each key in tables below `path`.

    closed: stretches that no row in time can reach any more; open: those of the last batch that one still can;
    late: rows behind the watermark, the latest time of the batches before less `delay_seconds`;
    high: the latest time of each batch.  Rows without a time have no place and are left out, those without a
    key are one key's.  What a batch reads of earlier ones are open stretches and one row for each batch, never rows or closed
    stretches; a batch that comes again writes the same.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, writer(batch.sparkSession)
        rows = batch.select(key, F.col(ts).cast("timestamp").alias("start_ts")).where("start_ts is not null").select(key, "start_ts", F.col("start_ts").alias("end_ts"), F.lit(1).cast("long").alias("n_events"))
        before = read_batches(spark, f"{path}/high", but=(own, number))
        mark = None if before is None else before.agg(F.max("at").alias("at")).first()["at"]
        high = rows.agg(F.max(seconds("start_ts")).alias("at"))
        newest = high.first()["at"]
        is_late = F.lit(False) if mark is None else seconds("start_ts") < mark - delay_seconds
        write_batch(rows.where(is_late), f"{path}/late", number)
        kept = batch_path(f"{path}/open", own, number - 1)
        parts = rows.where(~is_late)
        parts = parts.unionByName(spark.read.schema(parts.schema).parquet(kept)) if exists(spark, f"{kept}/_SUCCESS") else parts
        now = stitched(parts, key, gap_seconds).withColumn("done", seconds("end_ts") + gap_seconds < max([x for x in (mark, newest) if x is not None], default=0.0) - delay_seconds)
        write_batch(now.where("done").drop("done"), f"{path}/closed", number)
        write_batch(now.where("not done").drop("done"), f"{path}/open", number)
        write_batch(high, f"{path}/high", number)
        remove(spark, batch_path(f"{path}/open", own, number - 2))  # batch `number` cannot ask for it any more

    return sink


def segments_with_late(spark: SparkSession, path: str, key: str = "session_id", gap_seconds: float = 900) -> DataFrame:
    """(key, start_ts, end_ts, n_events) of all rows a `segment_sink` has met, late ones stitched into the stretches they touch.

    Only keys with late rows are stitched again.
    """
    closed = read_batches(spark, f"{path}/closed").unionByName(last_batches(spark, f"{path}/open"))
    late = read_batches(spark, f"{path}/late")
    keys = late.select(key).distinct()
    same = closed[key].eqNullSafe(keys[key])
    touched = closed.join(keys, same, "left_semi").unionByName(late)
    return closed.join(keys, same, "left_anti").unionByName(stitched(touched, key, gap_seconds))

"""Tables that grow by numbered batches, each written once however often it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.sources.tables import exists, subfolders

BY_HAND = "none"


def writer(spark: SparkSession) -> str:
    """Id of the streaming query whose batch is being written, the same after a restart; BY_HAND outside of one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or BY_HAND


def write_batch(rows: DataFrame, path: str, number: int | str, query: str | None = None) -> None:
    """Write a batch to a folder of its query and number, in place of what an earlier try left there.

    The file commit's marker says that the folder is whole; no other folder is read or
    touched, so the cost of a batch is its own size, not the table's.
    """
    rows.write.mode("overwrite").parquet(batch_path(path, query or writer(rows.sparkSession), number))


def batch_path(path: str, query: str, number: int | str) -> str:
    return f"{path}/{query}/{number}"


def last_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """The whole batch of the highest number of each query; None where there are none."""
    found = []
    for query in subfolders(spark, path):
        whole = [p for p in subfolders(spark, query) if exists(spark, f"{p}/_SUCCESS")]
        found += sorted(whole, key=lambda p: int(p.rsplit("/", 1)[-1]))[-1:]
    return spark.read.parquet(*found) if found else None


def read_batches(spark: SparkSession, path: str, but: tuple[str, int | str] | None = None) -> DataFrame | None:
    """All whole batches of a table but one (query, number); None where there are none."""
    skipped = f"/{but[0]}/{but[1]}" if but else None
    found = [p for query in subfolders(spark, path) for p in subfolders(spark, query) if exists(spark, f"{p}/_SUCCESS") and not (skipped and p.endswith(skipped))]
    return spark.read.parquet(*found) if found else None

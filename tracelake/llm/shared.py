"""Helpers that the operators share: shared folders, reliable cuts of the lineage, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset, as in
    tests, the warehouse folder of the session stands in.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


@contextmanager
def short_shuffles(spark: SparkSession):
    """Within, the shuffle files of a query go when it ends."""
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if kept is None else spark.conf.set(CLEANUP, kept)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that lost executors cost no recomputation.

    The table replaces the shuffles that made it, whose files are deleted.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with short_shuffles(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_stored(frame: DataFrame) -> None:
    """Delete the files of a frame from `stored` that no later step reads."""
    spark = frame.sparkSession
    jvm = spark.sparkContext._jvm
    for file in frame.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable from each vertex of an undirected graph.

    `edges` has long columns a and b.  Each round every vertex takes the smallest
    label among itself, its neighbours and its label's label, so that long chains
    halve; rounds end when no label changes.  Self-loops and repeated edges are
    fine, rows with a null end are ignored, an empty frame gives an empty frame.
    Returns (v, component).
    """
    spark = edges.sparkSession
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = stored(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        far = labels.select(F.col("v").alias("component"), F.col("component").alias("far"))
        step = (
            labels.join(near, "v", "left")
            .join(far, "component", "left")
            .select("v", F.col("component").alias("was"), F.least("component", "near", "far").alias("component"))
        )
        new = stored(step, "labels")
        changed = new.where("component <> was").limit(1).count()
        drop_stored(labels)
        labels = new.select("v", "component")
        if not changed:
            drop_stored(both)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

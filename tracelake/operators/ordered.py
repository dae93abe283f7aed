"""The row before and running values in a key's order, where one key may hold a large share of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.vectors import _cut
from tracelake.sources.tables import stored

HOT_ROWS = 1_000_000


def deal(rows: DataFrame, key: str, order: tuple[str, ...], hot_rows: int | None = None) -> DataFrame:
    """Rows with _part, if a key has over `hot_rows`: its parts follow each other in `order` and hold about that many.

    Only rows of such keys are put in ranges, and written, so that each later step sees
    the same parts; the others are part 0.  Rows equal in key and order stay together.
    Without such a key the rows stay as they are.
    """
    most = hot_rows or HOT_ROWS
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    found = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    if not found:
        return rows
    hot, same = stored(counts, "hot-keys"), F.col(key).eqNullSafe(F.col("_key"))
    ranges = rows.join(hot, same, "left_semi").repartitionByRange(math.ceil(found / most), key, *order)
    parted = _cut(ranges.withColumn("_part", F.spark_partition_id() + 1))
    return rows.join(hot, same, "left_anti").withColumn("_part", F.lit(0)).union(parted)


def _parts(dealt: DataFrame, key: str) -> list[str]:
    return [key, *[c for c in ("_part",) if c in dealt.columns]]


def with_previous(dealt: DataFrame, key: str, order: tuple[str, ...], fields: tuple[str, ...], name: str = "_prev") -> DataFrame:
    """Add the struct of `fields` of the row before of the same key, null for a key's first."""
    value = F.struct(*fields)
    before = F.lag(value).over(Window.partitionBy(*_parts(dealt, key)).orderBy(*order))
    last = F.lag("_value").over(Window.partitionBy("_key").orderBy("_at"))
    return _stitched(dealt.withColumn(name, before), key, F.max_by(value, F.struct(*order)), last, F.coalesce(F.col(name), F.col("_edge")), name)


def running(dealt: DataFrame, key: str, order: tuple[str, ...], value: Column, how: str, name: str) -> DataFrame:
    """Add the sum or the max (`how`) of a value over a key's rows up to each one."""
    fold, own, edge = {"sum": F.sum, "max": F.max}[how], F.col(name), F.col("_edge")
    w = Window.partitionBy(*_parts(dealt, key)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = fold("_value").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    both = F.coalesce(own + edge, own, edge) if how == "sum" else F.greatest(own, edge)
    return _stitched(dealt.withColumn(name, fold(value).over(w)), key, fold(value), before, both, name)


def _stitched(rows: DataFrame, key: str, whole: Column, carried: Column, both: Column, name: str) -> DataFrame:
    """A column found within parts, joined with what the parts before carry over: one row for each part of a large key."""
    if "_part" not in rows.columns:
        return rows
    parts = rows.where("_part > 0").groupBy(F.col(key).alias("_key"), F.col("_part").alias("_at")).agg(whole.alias("_value"))
    edges = parts.select("_key", "_at", carried.alias("_edge"))
    met = rows.join(edges, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    return met.withColumn(name, both).drop("_key", "_at", "_edge")

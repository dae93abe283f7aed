"""The novelty gate over nearest vectors, and points of one id."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.neighbours import CHUNK_ROWS, SLACK, best_of_batch, cosine, knn, lsh_best, rounded, unit_rows, usable
from tracelake.sources.tables import shared_folder, stored

__all__ = ["best_of_batch", "cosine", "dedupe_points", "gate_counts", "knn", "lsh_best", "novelty_gate"]

#: Undecided vectors that the greedy gate decides at once, and of those the rows multiplied at once.
HEAD_ROWS, STRETCH = 8192, 256


def _gate(best: Column, reject: float, refine: float) -> Column:
    return F.when(best > reject, "duplicate").when(best >= refine, "refinement").otherwise("novel")


def novelty_gate(candidates: DataFrame, existing: DataFrame, reject: float = 0.85, refine: float = 0.70, mode: str = "existing") -> DataFrame:
    """(vec_id, best, verdict) of candidates (vec_id, embedding): duplicate, refinement or novel.

    `existing` compares with the stored vectors, `any_earlier` with candidates of smaller id
    too, `greedy` with stored vectors and candidates accepted earlier: the undecided of smallest ids
    are decided together, then all that repeat one accepted of them go; no pair is kept.  `lsh` compares with the
    stored vectors that share a band of hyperplanes: it may miss one in a hundred duplicates,
    and scores below `reject` are of those it met.  Vectors without a direction are novel.
    """
    if mode == "lsh":
        met = lsh_best(candidates.select(F.col("vec_id").alias("query_id"), "embedding"), existing, reject)
        return met.select(F.col("query_id").alias("vec_id"), "best", _gate(F.coalesce("best", F.lit(-1.0)), reject, refine).alias("verdict"))
    ids = candidates.select(F.col("vec_id").alias("query_id"), "embedding")
    against = knn(ids, existing, k=1, floor=-1.0, allow_self=True).select(F.col("query_id").alias("vec_id"), F.col("score").alias("old"))
    out = candidates.select("vec_id").join(against, "vec_id", "left")
    if mode == "existing":
        return out.select("vec_id", F.col("old").alias("best"), _gate(F.coalesce("old", F.lit(-1.0)), reject, refine).alias("verdict"))
    if mode == "any_earlier":
        own = knn(ids, candidates, k=1, floor=-1.0, earlier_only=True).select(F.col("query_id").alias("vec_id"), F.col("score").alias("new"))
        best = F.greatest("old", "new")
        return out.join(own, "vec_id", "left").select("vec_id", best.alias("best"), _gate(F.coalesce(best, F.lit(-1.0)), reject, refine).alias("verdict"))
    out = stored(out, "nearest-stored")
    near = out.where(F.col("old") > reject).select("vec_id").distinct()
    left = candidates.where("vec_id is not null").where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").join(near, "vec_id", "left_anti")
    left = stored(left, "undecided")
    repeats = left.select("vec_id").distinct().join(_greedy(left, reject), "vec_id", "left_anti")
    refused = near.union(repeats).withColumn("refused", F.lit(True))
    verdict = F.when(F.col("refused"), "duplicate").when(F.coalesce("old", F.lit(-1.0)) >= refine, "refinement").otherwise("novel")
    return out.join(refused, "vec_id", "left").select("vec_id", F.col("old").alias("best"), verdict.alias("verdict"))


def _greedy(rows: DataFrame, reject: float) -> DataFrame:
    """(vec_id) of vectors that none of a smaller id among these, taken before them, repeats.

    In each round one task decides the HEAD_ROWS undecided of the smallest ids, and all others meet what it took; those that
    repeat one of these are not written again.
    """
    kind, taken = rows.schema["embedding"].dataType.simpleString(), []
    fields, cores = f"vec_id long, embedding {kind}", rows.sparkSession.sparkContext.defaultParallelism
    while True:
        head = rows.select("vec_id").orderBy("vec_id").limit(HEAD_ROWS).agg(F.max("vec_id").alias("last")).first()["last"]
        if head is None:
            return functools.reduce(DataFrame.union, [t.select("vec_id") for t in taken]).distinct() if taken else rows.select("vec_id")
        first = rows.where(F.col("vec_id") <= head).withColumn("part", F.lit(0)).groupBy("part").applyInArrow(lambda t: _settled(t, reject), fields)  # HEAD_ROWS, but for rows of one id
        taken.append(stored(first, "taken"))
        rest = rows.where(F.col("vec_id") > head)
        n = rest.count()
        parts = max(1, -(-n // CHUNK_ROWS), min(cores, n // 1024))
        ours = rest.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
        theirs = taken[-1].withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        met = ours.groupBy("part").cogroup(theirs.groupBy("part")).applyInArrow(lambda x, y: _unlike(x, y, reject), fields)
        rows = stored(met, "undecided")


def _lengths(column: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Rows by the length of their vectors."""
    n = np.asarray(pc.list_value_length(column))
    return {d: np.flatnonzero(n == d) for d in np.unique(n).tolist()}


def _above(s: np.ndarray, reject: float) -> np.ndarray:
    """Whether scores are above a bound once they are rounded to six digits."""
    out, unsure = s > reject, np.abs(s - reject) < SLACK
    out[unsure] = rounded(s[unsure]) / 1e6 > reject
    return out


def _near_any(units: np.ndarray, others: np.ndarray, reject: float) -> np.ndarray:
    """Which unit vectors have one of the others above the bound."""
    out = np.zeros(len(units), bool)
    for at in range(0, len(units) if len(others) else 0, STRETCH):
        out[at : at + STRETCH] = _above(units[at : at + STRETCH] @ others.T, reject).any(axis=1)
    return out


def _unlike(ours: pa.Table, theirs: pa.Table, reject: float) -> pa.Table:
    """Rows of ours without one of theirs above the bound; an id goes with all its vectors."""
    ours = ours.select(["vec_id", "embedding"])
    if not ours.num_rows or not theirs.num_rows:
        return ours
    near, others = np.zeros(ours.num_rows, bool), _lengths(theirs["embedding"])
    for d, own in _lengths(ours["embedding"]).items():
        if d in others:
            near[own] = _near_any(*(unit_rows(t["embedding"].take(pa.array(i))) for t, i in ((ours, own), (theirs, others[d]))), reject)
    ids = np.asarray(ours["vec_id"])
    return ours.filter(pa.array(~np.isin(ids, ids[near])))


def _settled(rows: pa.Table, reject: float) -> pa.Table:
    """Of some vectors those that none of a smaller id, taken before them, repeats; an id goes with all its vectors.

    A stretch of ids is compared with all that was taken before it and with itself, then its ids are taken one after another.
    """
    rows = rows.select(["vec_id", "embedding"]).sort_by("vec_id")
    ids, keep, units, length, place = np.asarray(rows["vec_id"]), np.zeros(rows.num_rows, bool), {}, *np.zeros((2, rows.num_rows), np.int64)
    for d, own in _lengths(rows["embedding"]).items():
        units[d], length[own], place[own] = unit_rows(rows["embedding"].take(pa.array(own))), d, np.arange(len(own))
    ends, taken, low = np.r_[np.flatnonzero(np.diff(ids)) + 1, len(ids)], {d: [] for d in units}, 0
    while low < len(ids):
        next_end, fits = np.searchsorted(ends, low, "right"), np.searchsorted(ends, low + STRETCH, "right") - 1
        high, alone = ends[max(next_end, fits)], fits <= next_end  # whole ids: as many as fit, or one
        near, links = np.zeros(high - low, bool), {}
        for d in np.unique(length[low:high]).tolist():
            own = low + np.flatnonzero(length[low:high] == d)
            u = units[d][place[own]]
            near[own - low] = _near_any(u, units[d][taken[d]], reject) if taken[d] else False
            if not alone:
                links[d] = own, _above(u @ u.T, reject)
        for at, end in zip(np.r_[low, ends[next_end : max(next_end, fits)]], ends[next_end : max(next_end, fits) + 1], strict=True):
            if near[at - low : end - low].any():
                continue
            keep[at:end] = True
            for i in range(at, end):
                d = int(length[i])
                taken[d].append(place[i])
                if d in links:
                    own, above = links[d]
                    near[own - low] |= above[np.searchsorted(own, i)]
        low = high
    return rows.filter(pa.array(keep))


def _cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint()


def gate_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").count()


def dedupe_points(rows: DataFrame, key: str = "event_id", order: str = "ord") -> DataFrame:
    """The first row of each id by `order`."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")

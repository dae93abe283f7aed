"""Nearest vectors by cosine: exact within cells around pivots, or by banded hyperplanes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.tables import stored

#: Vectors of a cell on average, until there are MOST_PIVOTS cells; vectors and queries of one group.
CELL_ROWS, MOST_PIVOTS = 10_000, 1024
CHUNK_ROWS, QUERY_ROWS = 16_384, 16_384
#: Rounding to six digits may lift a score by half a millionth.
SLACK = 1.1e-6
#: Hyperplanes: share of the pairs at the bound that must meet, and most bands for it.
LSH_RECALL, MOST_BANDS = 0.985, 96
FOUND = "query_id long, vec_id long, score double"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector has a direction: not null, all components finite, one of them not 0."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a list column whose rows have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(pc.list_flatten(column)).astype(np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def rounded(s: np.ndarray, digits: int = 6) -> np.ndarray:
    """Scores in whole units of the last digit, halves away from zero as F.round takes them."""
    r = np.floor(np.abs(s) * 10.0**digits + 0.5)
    plain = np.where(np.isfinite(s), np.abs(s) * 10.0**digits + 0.5, 0.25)
    unsure = np.abs(plain - np.rint(plain)) < 1e-6
    r[unsure] = [float(Decimal(repr(x)).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP)) for x in np.abs(s[unsure]).tolist()]
    return np.copysign(r, s)


def best_of_batch(s: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Which scores (vectors in rows, queries in columns) are among the k best of their column by (rounded score, vec_id); -inf never is.

    Only what may round to the k-th score or above is rounded and put in order.
    """
    keep = np.zeros(s.shape, bool)
    if len(s) > k:
        least = s.max(axis=0) if k == 1 else np.partition(s, len(s) - k, axis=0)[len(s) - k]
        i, j = np.nonzero((s >= least - 2 * SLACK) & (s > -np.inf))
    else:
        i, j = np.nonzero(s > -np.inf)
    order = np.lexsort((vec[i], -rounded(s[i, j]), j))
    i, j = i[order], j[order]
    first = np.arange(len(j)) - np.searchsorted(j, j, "left") < k
    keep[i[first], j[first]] = True
    return keep


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch by the length of their vectors."""
    n = np.asarray(pc.list_value_length(batch.column(column)))
    for d in np.unique(n).tolist():
        yield d, np.flatnonzero(n == d)


class Cells:
    """Pivots by vector length, with the number and the nearest and farthest angle of the vectors around each."""

    def __init__(self, pivots: list[list[float]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in sorted({len(p) for p in pivots}):
            own = [i for i, p in enumerate(pivots) if len(p) == d]
            m = np.array([pivots[i] for i in own], np.float64)
            self.of[d] = (np.array(own, np.int64), m / np.linalg.norm(m, axis=1, keepdims=True))
        self.count, self.near, self.far = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.full(len(pivots), -1.0)

    def angles(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, angle to each) for unit vectors of one length; a length without a pivot has one cell, -1, at no distance."""
        cells, pivots = self.of.get(unit.shape[1], (np.array([-1]), None))
        return cells, (np.zeros((len(unit), 1)) if pivots is None else np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0)))

    def best_score(self, cells: np.ndarray, angle: np.ndarray) -> np.ndarray:
        """What a vector of a cell can score at most, by the triangle inequality of angles; an empty cell gives nothing."""
        if cells[0] < 0:
            return np.full(angle.shape, 2.0)
        gap = np.maximum(0.0, np.maximum(angle - self.far[cells], self.near[cells] - angle))
        return np.where(self.count[cells] > 0, np.cos(gap) + 1e-9, -2.0)


def _visits(queries: DataFrame, cells, k: int | None, floor: float, rest: bool) -> DataFrame:
    """(query_id, cell, query): the cells that a query looks into.

    At first, the nearest ones that hold enough vectors for k results; as the rest,
    all others in which a vector may still come up to the query's `bar` and the floor.  Without k
    there is no first pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cells.value
        for batch in batches:
            bar = np.maximum(floor, np.asarray(batch.column("bar"), np.float64)) - SLACK if rest else None
            for _, rows in _by_length(batch, "query"):
                part = batch.take(pa.array(rows))
                numbers, angle = known.angles(unit_rows(part.column("query")))
                best = known.best_score(numbers, angle)
                if k is None:
                    go = best >= bar[rows][:, None]
                else:
                    order = np.argsort(angle, axis=1, kind="stable")
                    held = np.full(order.shape, 1 << 60) if numbers[0] < 0 else known.count[numbers][order]
                    before = np.cumsum(held, axis=1) - held
                    first = np.zeros(angle.shape, bool)
                    np.put_along_axis(first, order, before < k + 1, axis=1)
                    go = ~first & (best >= bar[rows][:, None]) if rest else first
                i, c = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(i)), pa.array(numbers[c]), part.column("query").take(pa.array(i))], ["query_id", "cell", "query"])

    kind = queries.schema["query"].dataType.simpleString()
    return queries.mapInArrow(run, f"query_id long, cell long, query {kind}")


def _matched(visits: DataFrame, dealt: DataFrame, parts: int, k: int | None, floor: float, earlier_only: bool, allow_self: bool) -> DataFrame:
    """Scores of queries with the vectors of the cells they visit, the k best of each group."""

    def match(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if earlier_only:  # in order of ids, a stretch of queries needs the vectors before its last alone
            asked, held = asked.sort_by("query_id"), held.sort_by("vec_id")
        ids, every = np.asarray(asked["query_id"]), np.asarray(held["vec_id"])
        q, units, out = unit_rows(asked["query"]), unit_rows(held["embedding"]), []
        for at in range(0, len(ids), 256):
            own = ids[at : at + 256]
            n = np.searchsorted(every, own[-1]) if earlier_only else len(every)
            vec, v = every[:n], units[:n]
            s = v @ q[at : at + 256].T
            ok = s >= floor - SLACK
            if earlier_only:
                ok &= vec[:, None] < own[None, :]
            elif not allow_self:
                ok &= vec[:, None] != own[None, :]
            if k is not None and len(vec) > k:
                ok &= best_of_batch(np.where(ok, s, -np.inf), vec, k)
            i, j = np.nonzero(ok)
            out.append((own[j], vec[i], s[i, j]))
        return pa.table({n: np.concatenate([o[c] for o in out]) for c, n in enumerate(("query_id", "vec_id", "score"))})

    keys = ["length", "cell", "chunk", "part"]
    own = visits.withColumns({"length": F.size("query"), "part": F.pmod(F.xxhash64("query_id"), F.lit(parts))})
    chunks = dealt.select("length", "cell", "chunks").distinct()
    asked = own.join(chunks, ["length", "cell"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    held = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return asked.select(*keys, "query_id", "query").groupBy(*keys).cogroup(held.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInArrow(match, FOUND)


def knn(queries: DataFrame, vectors: DataFrame, k: int | None = 500, floor: float = 0.3, earlier_only: bool = False, allow_self: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of `vectors` (vec_id, embedding) to each query (query_id, embedding).

    Vectors lie in cells around pivots.  A query first looks into the cells nearest to it
    that hold k vectors; its k-th score then bars all cells whose vectors, by the triangle inequality of
    angles, stay below it.  Cells and queries meet in groups of bounded size, so no query passes through the
    driver.  Scores are rounded to six digits, ties go by vec_id.  Without k all pairs from `floor` on return,
    without rank.  `earlier_only` compares with smaller ids alone.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without an id, are neither asked for nor found; vectors of different lengths are never compared.
    """
    spark = queries.sparkSession
    asked = stored(queries.where("query_id is not null").where(usable()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("query")), "queries")
    held = vectors.where("vec_id is not null").where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n = held.count()
    pivots = held.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(max(1, min(MOST_PIVOTS, n // cell_rows))).collect()  # MOST_PIVOTS at most
    cells = Cells([[float(x) for x in r["embedding"]] for r in pivots])
    shared = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in _by_length(batch, "embedding"):
                part = batch.take(pa.array(rows))
                numbers, angle = shared.value.angles(unit_rows(part.column("embedding")))
                least = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers[least]), pa.array(angle[np.arange(len(rows)), least])], ["vec_id", "embedding", "cell", "angle"])

    kind = held.schema["embedding"].dataType.simpleString()
    placed = stored(held.mapInArrow(place, f"vec_id long, embedding {kind}, cell long, angle double"), "cells")
    sizes = placed.groupBy(F.size("embedding").alias("length"), "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
    for r in sizes.where("cell >= 0").collect():  # one row for each pivot
        cells.count[r["cell"]], cells.near[r["cell"]], cells.far[r["cell"]] = r["n"], r["near"], r["far"]
    known = spark.sparkContext.broadcast(cells)
    chunks = sizes.select("length", "cell", F.ceil(F.col("n") / CHUNK_ROWS).cast("long").alias("chunks"))
    dealt = placed.withColumn("length", F.size("embedding")).join(chunks, ["length", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks"))
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    match = lambda visits: _matched(visits, dealt, parts, k, floor, earlier_only, allow_self)
    near = lambda found: found.withColumn("score", F.round("score", 6)).where(F.col("score") >= floor)
    if k is None:
        return near(match(_visits(asked.withColumn("bar", F.lit(floor)), known, None, floor, True)))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    first = ranked(near(match(_visits(asked, known, k, floor, False))))
    if len(pivots) <= 1:  # one cell was all
        return first
    first = stored(first, "first-neighbours")
    bars = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar")).groupBy("query_id").agg(F.max("bar").alias("bar"))
    barred = asked.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(floor)))
    rest = near(match(_visits(barred, known, k, floor, True)))
    return ranked(first.drop("rank").unionByName(rest))


def hyperplane_shape(bound: float, recall: float = LSH_RECALL) -> tuple[int, int]:
    """(bits, bands): the most bits a band may have if a pair of cosine `bound` shall share one of MOST_BANDS bands or fewer with this chance."""
    same = 1 - math.acos(max(-1.0, min(1.0, bound))) / math.pi
    best = (1, 1)
    for bits in range(1, 33):
        bands = 1 if same**bits >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same**bits))
        if bands > MOST_BANDS:
            break
        best = (bits, bands)
    return best


def banded(rows: DataFrame, name: str, bits: int, bands: int) -> DataFrame:
    """(band, key, id, vector) for each band of each vector: the sides of `bits` hyperplanes that it lies on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at in _by_length(batch, "embedding"):
                part = batch.take(pa.array(at))
                planes = np.random.default_rng(d).standard_normal((d, bits * bands))
                sides = (unit_rows(part.column("embedding")) @ planes > 0).reshape(len(at), bands, bits)
                key = (sides * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)
                row, band = np.repeat(np.arange(len(at)), bands), np.tile(np.arange(bands), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(key.ravel()), part.column(name).take(pa.array(row)), part.column("embedding").take(pa.array(row))], ["band", "key", name, "embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select(name, "embedding").mapInArrow(run, f"band long, key long, {name} long, embedding {kind}")


def lsh_best(queries: DataFrame, vectors: DataFrame, bound: float, recall: float = LSH_RECALL) -> DataFrame:
    """(query_id, best): the highest cosine of a query with the vectors that share a band with it, null without one.

    A pair of cosine `bound` or more shares a band with a chance of `recall` at least, and what is found is
    exact.  Equal vectors are compared once.  A crowded bucket is dealt in chunks of CHUNK_ROWS vectors.
    """
    bits, bands = hyperplane_shape(bound, recall)
    asked = stored(queries.where("query_id is not null").where(usable()).select(F.col("query_id").cast("long").alias("query_id"), "embedding"), "queries")
    kinds = vectors.where(usable()).groupBy("embedding").agg(F.min("vec_id").cast("long").alias("vec_id"))
    held = stored(banded(kinds, "vec_id", bits, bands).withColumn("length", F.size("embedding")), "bands")
    keys = ["length", "band", "key"]
    crowded = held.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("long").alias("chunks"))
    dealt = held.join(crowded, keys).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks"))
    mine = banded(asked, "query_id", bits, bands).withColumn("length", F.size("embedding")).join(crowded, keys).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def match(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "best": pa.array([], pa.float64())})
        q, v = unit_rows(ours["embedding"]), unit_rows(theirs["embedding"])
        best = [(q[at : at + 256] @ v.T).max(axis=1) for at in range(0, len(q), 256)]
        return pa.table({"query_id": ours["query_id"], "best": np.concatenate(best)})

    place = [*keys, "chunk"]
    met = mine.select(*place, "query_id", "embedding").groupBy(*place).cogroup(dealt.select(*place, "vec_id", "embedding").groupBy(*place)).applyInArrow(match, "query_id long, best double")
    best = met.groupBy("query_id").agg(F.round(F.max("best"), 6).alias("best"))
    return queries.select("query_id").join(best, "query_id", "left")

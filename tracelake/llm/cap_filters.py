"""Links between embeddings of cosine 0.9 or more, found by spherical-cap filters.

A filter is a direction; a unit vector passes it if their inner product reaches t
standard deviations of a random direction's, so near vectors pass many filters
together and unrelated ones hardly any.  The directions are a random product code:
each is a word of a first and a word of a second random code, side by side.  Sorted
inner products with the second code list, for each word of the first, all partners
that reach the bound, without looking at the other directions.  t and the number of
directions follow from the number of vectors.  Vectors of few dimensions are first
turned into LEAST_DIMENSION, where inner products with directions spread normally.

Vectors meet at the filters they share and are compared in double precision.  A pair
counts only at the smallest filter that both pass, so links are counted without being
listed.  Equal vectors form one class, and a filter that more than GROUP vectors pass
is dealt out in chunks, each pair of chunks apart.  An entry carries the vector and
its smaller filters only, and the entries are dealt and compared in passes, so that
the shuffle on disk holds those of one pass.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.kernels import mix
from tracelake.llm.shared import connected_components, drop_stored, stored

COSINE = 0.9
TABLES = 2
COMMON = 14  # expected number of filters that a pair of cosine 0.9 shares
GROUP, MOST_HOT, MOST_CHUNKS = 512, 100_000, 60_000
LEAST_DIMENSION = 64
ENTRY_BYTES, BUCKET_BYTES = 420, 16 << 20
PASS_BYTES = 256 << 20  # dealt in one pass, or the size of the vectors if that is more
SEED = 11
_U = np.uint64


def _tail(t: np.ndarray | float) -> np.ndarray:
    """Upper tail of the normal distribution, by its continued fraction or series through numpy only."""
    x = np.linspace(0, 12, 24001)
    density = np.exp(-0.5 * x * x) / np.sqrt(2 * np.pi)
    area = np.concatenate([np.cumsum(((density[1:] + density[:-1]) * 0.5 * (x[1] - x[0]))[::-1])[::-1], [0.0]])
    t = np.asarray(t, float)
    return np.where(t >= 0, np.interp(np.abs(t), x, area), 1 - np.interp(np.abs(t), x, area))


class Caps:
    """Codes and bound for n vectors of a dimension."""

    def __init__(self, n: int, dimension: int):
        occupancy = 2.0 / max(n, 200)
        grid = np.linspace(2.0, 9.0, 1401)
        self.t = float(grid[np.argmin(np.abs(np.log(_tail(grid) + 1e-300) - np.log(occupancy)))])
        x = np.linspace(self.t, self.t + 6, 2001)
        weight = np.exp(-0.5 * x * x)
        both = float((weight * _tail((self.t - COSINE * x) / np.sqrt(1 - COSINE**2))).sum() / weight.sum())
        filters = COMMON / both / float(_tail(self.t)) / TABLES
        self.words = max(4, int(np.ceil(np.sqrt(filters))))
        self.dimension = max(dimension, LEAST_DIMENSION)
        self.bound, self.half = self.t / np.sqrt(self.dimension), self.dimension // 2
        self.per_vector = COMMON / both
        self.turn = None
        if dimension < LEAST_DIMENSION:
            self.turn = np.linalg.qr(np.random.default_rng(SEED).standard_normal((self.dimension, dimension)))[0].T

    def codes(self) -> list[tuple[np.ndarray, np.ndarray]]:
        rng = np.random.default_rng(SEED)
        out = []
        for _ in range(TABLES):
            pair = []
            for size in (self.half, self.dimension - self.half):
                c = rng.standard_normal((self.words, size))
                pair.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(size / self.dimension))
            out.append(tuple(pair))
        return out

    def passed(self, unit: np.ndarray, codes) -> tuple[np.ndarray, np.ndarray]:
        """Filters (uint32 names) that each unit vector passes, end to end, and their offsets."""
        unit = unit if self.turn is None else unit @ self.turn
        rows, w = len(unit), self.words
        apart = 10.0 * np.arange(rows)[:, None]  # inner products are below 1, so rows stay apart in one sorted array
        found = []
        for table, (first, second) in enumerate(codes):
            a, b = unit[:, : self.half] @ first.T, unit[:, self.half :] @ second.T
            order = np.argsort(-b, axis=1)
            down = (apart - np.take_along_axis(b, order, axis=1)).ravel()
            n, few = np.zeros((rows, w), np.int64), np.arange(rows)
            for slack in (0.0, 0.5, 1.0):  # a vector far from all directions takes nearer ones
                reach = apart[few] + a[few] - (self.bound - slack / np.sqrt(self.dimension))
                n[few] = np.searchsorted(down, reach.ravel(), "right").reshape(len(few), w) - few[:, None] * w
                few = few[n[few].sum(axis=1) * TABLES * 3 < self.per_vector]
            few = np.flatnonzero(n.sum(axis=1) == 0)
            n[few, np.argmax(a[few], axis=1)] = 1
            n = n.ravel()
            cell = np.repeat(np.arange(rows * w), n)
            row, left = cell // w, cell % w
            right = order[row, np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)]
            name = mix(((_U(table) * _U(w) + left.astype(np.uint64)) * _U(w)) + right.astype(np.uint64) + _U(1)) >> _U(32)
            found.append((row.astype(np.uint64) << _U(32)) | name)
        pairs = np.unique(np.concatenate(found))
        owner = (pairs >> _U(32)).astype(np.int64)
        return (pairs & _U(0xFFFFFFFF)).astype(np.uint32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimension)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def filter_names(vectors: DataFrame, caps: Caps, dimension: int) -> DataFrame:
    """(cls, n, embedding, filters) with the filters that each vector passes."""

    def run(batches):
        codes = caps.codes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                names, offsets = caps.passed(_unit(_matrix(batch.column("embedding"), dimension)), codes)
                out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(names.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.select(["cls", "n", "embedding"]).columns, out], ["cls", "n", "embedding", "filters"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("cls", "n", "embedding").mapInArrow(run, f"cls long, n long, embedding {kind}, filters array<int>")


_DEALT = "bucket long, key binary, chunk binary, cls binary, n binary, vectors binary, sizes binary, filters binary"


def deal(vectors: DataFrame, hot, group: int, buckets: int, dimension: int, passes: int = 1, now: int = 0) -> DataFrame:
    """Vectors dealt to the buckets of their filters, packed by batch and bucket.

    `hot` broadcasts (names, counts) of the filters that are split, MOST_HOT at most.
    The key of an entry is (filter, chunk of the one side, chunk of the other).  Each key
    belongs to one of the `passes`, and only those of pass `now` are dealt.  An entry
    lists the vector's filters below its own.
    """

    def run(batches):
        hot_names, hot_counts = hot.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column("filters")
                size = np.asarray(lists.value_lengths()).astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(size)])
                names = np.asarray(lists.flatten()).view(np.uint32)
                owner = np.repeat(np.arange(batch.num_rows), size)
                cls = np.asarray(batch.column("cls"))
                place = np.minimum(np.searchsorted(hot_names, names), max(len(hot_names) - 1, 0))
                split = np.ones(len(names), np.int64)
                if len(hot_names):
                    split = np.where(hot_names[place] == names, -(-hot_counts[place] // group), 1)
                chunk = (mix(cls.view(np.uint64))[owner] % split.astype(np.uint64)).astype(np.int64)
                each = np.repeat(np.arange(len(names)), split)
                other = np.arange(len(each)) - np.repeat(np.cumsum(split) - split, split)
                mine = chunk[each]
                key = (names[each].astype(np.uint64) << _U(32)) | (np.minimum(mine, other).astype(np.uint64) << _U(16)) | np.maximum(mine, other).astype(np.uint64)
                place = mix(key)
                mine_now = np.flatnonzero(place % _U(passes) == _U(now))
                each, key, mine, place = each[mine_now], key[mine_now], mine[mine_now], place[mine_now]
                bucket = (place // _U(passes) % _U(buckets)).astype(np.int64)
                if not len(each):
                    continue
                order = np.argsort(bucket, kind="stable")
                v, n = _matrix(batch.column("embedding"), dimension), np.asarray(batch.column("n"))
                edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
                rows = []
                for a, b in zip(edges.tolist(), [*edges.tolist()[1:], len(order)], strict=True):
                    pick = order[a:b]
                    who = owner[each[pick]]
                    flat = np.concatenate([names[begin[w] : e] for w, e in zip(who.tolist(), each[pick].tolist(), strict=True)])  # a vector's filters are sorted
                    rows.append((int(bucket[pick[0]]), key[pick].tobytes(), mine[pick].astype(np.int32).tobytes(), cls[who].tobytes(), n[who].astype(np.int64).tobytes(), v[who].tobytes(), (each[pick] - begin[who]).astype(np.int32).tobytes(), flat.tobytes()))
                if rows:
                    kinds = [pa.int64(), *[pa.binary()] * 7]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _DEALT.split(", ")])

    return vectors.mapInArrow(run, _DEALT)


def link(table: pa.Table, dimension: int, kind: str = "f4") -> pa.Table:
    """(kind 0: class, linked vectors) and (kind 1: edge) of the pairs whose smallest common filter is in this bucket."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    key, chunk, cls, n = join("key", np.uint64), join("chunk", np.int32), join("cls", np.int64), join("n", np.int64)
    v, size = _unit(join("vectors", kind).reshape(-1, dimension)), join("sizes", np.int32).astype(np.int64)
    names, at = join("filters", np.uint32), np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(head, len(key)))
    links, edges = [], []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        links.append((cls[i], n[j]))
        links.append((cls[j], n[i]))

    for g in range(2, 9):
        starts = head[length == g]
        for x, y in combinations(range(g), 2) if len(starts) else ():
            i, j = order[starts + x], order[starts + y]
            near = (np.einsum("ij,ij->i", v[i], v[j]) >= COSINE) & _sides(key[i], chunk[i], chunk[j]) & (cls[i] != cls[j])
            keep = [(a, b) for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True) if not len(np.intersect1d(names[at[a] : at[a + 1]], names[at[b] : at[b + 1]], True))]
            if keep:
                i, j = np.array(keep).T
                add(i, j)
                edges.append((cls[i], cls[j]))
    for s, g in zip(head[length > 8].tolist(), length[length > 8].tolist(), strict=True):
        who = order[s : s + g]
        near = v[who] @ v[who].T >= COSINE
        near &= _sides(key[who[0]], chunk[who][:, None], chunk[who][None, :]) & (cls[who][:, None] != cls[who][None, :])
        if not near.any():
            continue
        own = np.repeat(np.arange(g), size[who])
        flat = np.concatenate([names[at[w] : at[w + 1]] for w in who.tolist()])
        kinds, back = np.unique(flat, return_inverse=True)
        passes = np.zeros((g, len(kinds)), np.float32)
        passes[own, back] = 1
        near &= passes @ passes.T == 0
        i, j = np.nonzero(np.triu(near, 1))
        if len(i):
            count = near @ n[who]
            links.append((cls[who][count > 0], count[count > 0]))
            label = np.arange(g)
            while True:
                new = np.minimum(label, np.where(near, label[None, :], g).min(axis=1))
                if (new == label).all():
                    break
                label = new
            far = label != np.arange(g)
            edges.append((cls[who][far], cls[who][label[far]]))
    pack = lambda k, parts: [np.full(sum(len(p[0]) for p in parts), k, np.int32), *(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in (0, 1))]
    a, b = pack(0, links), pack(1, edges)
    return pa.table({name: np.concatenate([x, y]) for name, x, y in zip(("kind", "a", "b"), a, b, strict=True)})


def _sides(key, left, right):
    """Whether two entries of a key stand on its two sides; a key of one chunk has one side only."""
    low, high = (key >> _U(16)) & _U(0xFFFF), key & _U(0xFFFF)
    return (low == high) | (left != right)


def _dimension_links(classes: DataFrame, dimension: int, kind: str) -> DataFrame:
    """(kind, a, b) as from `link` for classes (cls, n, embedding) of vectors of one dimension."""
    spark = classes.sparkSession
    count = classes.count()
    caps = Caps(count, dimension)
    named = stored(filter_names(classes, caps, dimension), "vector-filters")
    entries = named.agg(F.sum(F.size("filters")).alias("e")).first()["e"] or 0
    group = max(GROUP, entries // MOST_HOT)
    crowded = named.select(F.explode("filters").alias("f")).groupBy("f").count().where(F.col("count") > group).collect()  # MOST_HOT rows at most
    names, counts = np.array([r["f"] for r in crowded], np.int32).view(np.uint32), np.array([r["count"] for r in crowded], np.int64)
    by_name = np.argsort(names)
    hot = spark.sparkContext.broadcast((names[by_name], counts[by_name]))
    group = max(group, int(counts.max(initial=0)) // MOST_CHUNKS + 1)  # a chunk's number has 16 bits
    width = int(kind[1])
    dealt = (entries + int((counts * (-(-counts // group) - 1)).sum())) * (ENTRY_BYTES + (width - 4) * dimension)
    passes = max(1, -(-dealt // max(PASS_BYTES, width * dimension * count)))
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt // passes // BUCKET_BYTES)
    found = None
    for now in range(passes):  # a pass's shuffle goes when its links are stored
        links = stored(deal(named, hot, group, buckets, dimension, passes, now).groupBy("bucket").applyInArrow(lambda t: link(t, dimension, kind), "kind int, a long, b long"), "vector-links")
        found = links if found is None else found.unionAll(links)
    drop_stored(named)
    return found


def cap_links(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of `vectors` (vec_id, embedding).

    Two vectors of one length link if their cosine in double precision is 0.9 or more;
    n_links counts the other vectors linked directly, component_id is the smallest
    vec_id reachable.  Vectors that are null, zero, hold null or non-finite components,
    or have no vec_id link with nothing.  Equal vectors link with each other and with
    the same others.  Lengths are taken one after the other, as a table has few.  Other
    columns are ignored, an empty table gives no rows.  No pair below 0.9 is linked; of
    those above, the filters find nearly all (the tests measure it).
    """
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    is_good = F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False))
    names = {"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("second"), "embedding")}  # 128 bits name a vector
    good = rows.where(is_good).withColumns(names)
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    dimensions = [r["d"] for r in classes.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    if not dimensions:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for d in dimensions:
        links = _dimension_links(classes.where(F.size("embedding") == d), d, kind)
        found = links if found is None else found.unionAll(links)
    n_links = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("others"))
    labels = connected_components(found.where("kind = 1").select("a", "b")).withColumnRenamed("v", "cls")
    joined = classes.select("cls", "h1", "h2", "vec_id", "n").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls")).join(n_links, "cls", "left")
    smallest = joined.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = joined.join(smallest, "component").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    keyed = rows.withColumns({name: F.when(is_good, h) for name, h in names.items()}).select("vec_id", "h1", "h2")
    out = keyed.join(known, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

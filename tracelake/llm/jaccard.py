"""Jaccard self-join of documents on word 5-gram sets by parity sketches.

A parity sketch flips one bit for each shingle, so the Hamming distance of two
sketches is at most the size of the symmetric difference of the two sets.  It is
used twice:

* Wide sketches find candidates.  Documents of one size band (sizes from 2^j up
  to 2^(j+1), those from 0.8 times the upper end on also take part in the next
  band) share a sketch of P parts.  Jaccard >= 0.8 allows a set of n shingles at
  most floor(n / 4) differing parts.  Order all (part, content) keys the same way
  for all documents: before the first key that two similar documents share, each
  has only differing parts.  So the first floor(n / 4) + 1 keys of each document
  are enough for the pair to meet, if either has more non-empty parts than that;
  documents that have not also join with one part for each shingle.
* Narrow sketches of 1,024 bits drop most false candidates before their sets are
  fetched and intersected.

Documents with the same set form one class and only classes are compared.  A key
that more than 8 classes share links each of them with two hubs: the member that
has most such keys, which near copies of one text leave to that text, and one drawn
by hash.  After the
components of the verified links are known, members of such a key that are still
apart are compared with each other, in chunks.  So no link between components is lost and no
group of similar texts is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.kernels import mix, row_shingles
from tracelake.llm.shared import connected_components, drop_stored, stored

WORDS = 16
HOT = 8
CHUNK = 4096
ENTRIES_PER_BUCKET = 1_000_000
_U = np.uint64


def row_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of each row end to end, their offsets) for blocks of a column."""
    for a, s, rows in row_shingles(column):
        for i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            s[i:j].sort()
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        new[rows[:-1][rows[:-1] < len(s)]] = True
        before = np.concatenate([[0], np.cumsum(new)])
        yield a, s[new], before[rows]


def per_row(values: np.ndarray, rows: np.ndarray, how: np.ufunc) -> np.ndarray:
    """how.reduce of each row's values, 0 where a row has none."""
    out = np.zeros(len(rows) - 1, values.dtype)
    full = rows[1:] > rows[:-1]
    if full.any():
        out[full] = how.reduceat(values, rows[:-1][full])
    return out


def classes(s: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row's set; 0 for an empty set."""
    n = np.diff(rows).astype(np.uint64)
    return np.where(n > 0, mix(per_row(mix(s), rows, np.add) + n), _U(0)).view(np.int64)


def narrow_sketch(s: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Parity sketches of 1,024 bits, one row of 16 words for each set."""
    n = len(rows) - 1
    own = np.repeat(np.arange(n), np.diff(rows))
    bit = (s & _U(WORDS * 64 - 1)).astype(np.int64)
    flips = np.bincount(own * (WORDS * 64) + bit, minlength=n * WORDS * 64).astype(np.uint8) & 1
    return np.packbits(flips.reshape(n, -1), axis=1, bitorder="little").view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n, cls, s0..s15) of each row of (doc_id, text, row_key)."""
    words = [f"s{i}" for i in range(WORDS)]

    def run(batches):
        for batch in batches:
            for a, s, rows in row_sets(batch.column("text")):
                part = batch.slice(a, len(rows) - 1)
                sketch = narrow_sketch(s, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_key"), pa.array(np.diff(rows).astype(np.int64)), pa.array(classes(s, rows)), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(WORDS))],
                    ["doc_id", "row_key", "n", "cls", *words],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, row_key long, n long, cls long, " + ", ".join(f"{w} long" for w in words))


def _band_keys(s: np.ndarray, rows: np.ndarray, band: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, number of keys of each row) of rows whose band is given, -1 for none."""
    n = np.diff(rows)
    use = band >= 0
    n = np.where(use, n, 0)
    keep = np.repeat(use, np.diff(rows))
    s = s[keep]
    rows = np.concatenate([[0], np.cumsum(n)])
    if not len(s):
        return
    parts = np.maximum(2, (2.0 ** (np.maximum(band, 0) + 1) / 3).astype(np.int64)).astype(np.uint64)
    own = np.repeat(np.arange(len(n)), n)
    part = ((s >> _U(32)) * parts[own]) >> _U(32)  # grows with s, which is sorted
    begin = np.ones(len(s), bool)
    begin[1:] = (part[1:] != part[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(begin)
    bits = np.bitwise_xor.reduceat(mix((s & _U(0xFFFFFFFF)) | (part << _U(32))), at)
    count = np.diff(np.append(at, len(s)))
    salt = mix((np.maximum(band, 0).astype(np.uint64)[own[at]] << _U(40)) + part[at] + _U(1))
    key = (mix(bits + salt) >> _U(4)) | ((_U(15) - np.minimum(count, 15).astype(np.uint64)) << _U(60))  # fuller parts first: they are rarer
    filled = bits != 0
    key, of = key[filled], own[at][filled]
    ends = np.cumsum(np.bincount(of, minlength=len(n)))
    most = n // 4 + 1
    picked, counts = [], np.zeros(len(n), np.int64)
    rare = []
    for i in np.flatnonzero(use).tolist():
        b = int(ends[i])
        mine = key[int(ends[i - 1]) if i else 0 : b]
        mine.sort()
        picked.append(mine[: most[i]])
        counts[i] = min(len(mine), most[i])
        if len(mine) < most[i]:
            rare.append(i)
    yield np.concatenate(picked) if picked else np.zeros(0, np.uint64), counts
    if rare:
        counts = np.zeros(len(n), np.int64)
        counts[rare] = np.minimum(most, n)[rare]
        single = [mix(s[rows[i] : rows[i] + counts[i]] + mix(np.array([band[i] + 1000], np.uint64))) for i in rare]
        yield np.concatenate(single), counts


def set_keys(s: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys and the class of each; sets of under four shingles can only equal each other."""
    n = np.diff(rows)
    home = np.where(n >= 4, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), -1)
    above = np.where((home >= 0) & (n * 10 >= 8 * 2 ** (home + 1)), home + 1, -1)
    keys, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for band in (home, above):
        for k, counts in _band_keys(s, rows, band):
            keys.append(k)
            own.append(np.repeat(cls, counts))
    return np.concatenate(keys), np.concatenate(own)


_PACKED = "bucket long, hot boolean, keys binary, classes binary"


def _packed(buckets, hot, keys, owners) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(hot, pa.bool_()), pa.array(keys, pa.binary()), pa.array(owners, pa.binary())], ["bucket", "hot", "keys", "classes"])


def deal_keys(docs: DataFrame, buckets: int) -> DataFrame:
    """Join keys of each batch, packed by bucket.

    Keys that many classes of one batch share are dealt out by class, not by key,
    as hot members; a marker with the smallest class goes to the key's own bucket.
    """

    def run(batches):
        for batch in batches:
            keys, own, seen = [], [], np.zeros(0, np.int64)
            for _, s, rows in row_sets(batch.column("text")):
                cls = classes(s, rows)
                _, first = np.unique(cls, return_index=True)
                new = np.zeros(len(cls), bool)
                new[first] = True
                new &= ~np.isin(cls, seen)
                seen = np.concatenate([seen, cls[new]])
                n = np.where(new, np.diff(rows), 0)
                k, o = set_keys(s[np.repeat(new, np.diff(rows))], np.concatenate([[0], np.cumsum(n)]), cls)
                keys.append(k)
                own.append(o)
            if not keys:
                continue
            key, cls = np.concatenate(keys), np.concatenate(own)
            order = np.argsort(key)
            key, cls = key[order], cls[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            run_length = np.diff(np.append(head, len(key)))
            crowded = np.repeat(run_length > HOT, run_length)
            marks = key[head[run_length > HOT]]
            out = [[], [], [], []]

            def put(where, hot, k, c):
                if not len(where):
                    return
                order = np.argsort(where, kind="stable")
                where, k, c = where[order], k[order], c[order]
                edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                for a, b in zip(edges, [*edges[1:], len(where)], strict=True):
                    for column, value in zip(out, (int(where[a]), hot, k[a:b].tobytes(), c[a:b].tobytes()), strict=True):
                        column.append(value)

            put((mix(key[~crowded]) % _U(buckets)).astype(np.int64), False, key[~crowded], cls[~crowded])
            put((mix(cls[crowded].view(np.uint64)) % _U(buckets)).astype(np.int64), True, key[crowded], cls[crowded])
            put((mix(marks) % _U(buckets)).astype(np.int64), False, marks, np.zeros(len(marks), np.int64))
            if out[0]:
                yield _packed(*out)

    return docs.mapInArrow(run, _PACKED)


def meet(table: pa.Table) -> pa.Table:
    """Candidate pairs (kind 0: two classes) and hot members (kind 1: key, class) of one bucket."""
    packed, hot = table.select(["keys", "classes"]).to_pylist(), table.column("hot").to_pylist()
    join = lambda name, which, kind: np.frombuffer(b"".join(r[name] for r, h in zip(packed, hot, strict=True) if h == which), kind)
    key, cls = join("keys", False, np.uint64), join("classes", False, np.int64)
    hot_key, hot_cls = join("keys", True, np.uint64), join("classes", True, np.int64)
    marked = np.unique(key[cls == 0])
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    new &= cls != 0
    key, cls = key[new], cls[new]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(key)))
    over = (size > HOT) | np.isin(key[head], marked)
    left, right = [], []
    for k in range(2, HOT + 1):
        starts = head[(size == k) & ~over]
        if len(starts):
            for i, j in combinations(range(k), 2):
                left.append(cls[starts + i])
                right.append(cls[starts + j])
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1) if left else np.zeros((2, 0), np.int64)
    many = np.repeat(over, size)
    k, c = np.concatenate([hot_key, key[many]]).view(np.int64), np.concatenate([hot_cls, cls[many]])
    return pa.table({"kind": pa.array(np.repeat(np.array([0, 1], np.int32), [pairs.shape[1], len(k)])), "a": np.concatenate([pairs[0], k]), "b": np.concatenate([pairs[1], c])})


def sketches_allow(a: str, b: str):
    """Condition that holds for all pairs with Jaccard >= 0.8: distance <= (n_a + n_b) / 9, and sizes within 0.8."""
    distance = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(WORDS)), F.lit(0))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (distance * 9 <= na + nb) & (na * 10 >= nb * 8) & (nb * 10 >= na * 8)


def _set_rows(docs: DataFrame) -> DataFrame:
    """(cls, shingles) of rows (cls, text)."""

    def run(batches):
        for batch in batches:
            for a, s, rows in row_sets(batch.column("text")):
                part = batch.slice(a, len(rows) - 1)
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(s.view(np.int64)))], ["cls", "shingles"])

    return docs.mapInArrow(run, "cls long, shingles array<long>")


def verified(pairs: DataFrame, rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose shingle sets have Jaccard >= 0.8.

    `rows` has (row_key, text), `kinds` the row_key of one document of each class.
    Only sets of classes in a pair are built.
    """
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(kinds.select("cls", "row_key"), "cls")
    sets = stored(_set_rows(rows.join(needed, "row_key").select("cls", "text")), "sets")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * 80).select("a", "b").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs` (doc_id, text; other columns are ignored).

    Documents link when their sets of five-word shingles have a Jaccard similarity
    of 0.8 or more; component_id is the smallest doc_id that links reach.  A text
    of one to four words is one shingle; null, empty and blank texts have none and
    link with nothing.  Repeated rows get equal results.  A null doc_id gets the
    smallest id of its component, or null; `kept` holds where doc_id equals
    component_id.  An empty table gives an empty one.  Exact up to collisions of
    64-bit hashes.
    """
    return jaccard_rows(docs).select("doc_id", "n_shingles", "component_id", "kept")


def jaccard_rows(docs: DataFrame) -> DataFrame:
    """The columns of `jaccard_components` with row_key, the hash of id and text, and component.

    component is one number for all rows that links join, whatever their ids, and null
    for texts without shingles.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    each = stored(describe(rows), "sets-described")
    words = [f"s{i}" for i in range(WORDS)]
    kinds = stored(
        each.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.min("n").alias("n"), *(F.min(w).alias(w) for w in words)),
        "set-classes",
    )
    entries = kinds.agg(F.coalesce(F.sum(F.floor(F.col("n") / 4) + 1), F.lit(0)).alias("k")).first()["k"] * 1.4
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries // ENTRIES_PER_BUCKET))
    met = stored(deal_keys(rows.select("text"), buckets).groupBy("bucket").applyInArrow(meet, "kind int, a long, b long"), "meetings")
    hot = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cls"))
    sketches = kinds.select("cls", "n", *words)

    def screened(pairs: DataFrame, name: str) -> DataFrame:
        x, y = sketches.alias("x"), sketches.alias("y")
        return stored(pairs.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls")).where(sketches_allow("x", "y")).select("a", "b"), name)

    shared_keys = hot.groupBy("cls").agg(F.count(F.lit(1)).alias("keys"))
    central = hot.join(shared_keys, "cls").groupBy("key").agg(F.max_by("cls", F.struct("keys", "cls")).alias("central"), F.min_by("cls", F.xxhash64(F.lit(-1), "cls")).alias("drawn"))
    star = hot.join(central, "key").select(F.col("cls"), F.explode(F.array("central", "drawn")).alias("hub")).where("cls <> hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"))
    tried = screened(met.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(star).distinct(), "pairs")
    links = stored(verified(tried, rows, kinds), "links")
    found = connected_components(links)
    # members of a hot key that are still in different components
    labelled = hot.join(found.withColumnRenamed("v", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    apart = labelled.join(mixed, "key").join(sketches, "cls")
    # the members of a key meet in pairs of chunks of about CHUNK members, each pair of chunks apart
    chunks = labelled.join(mixed, "key").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
    apart = apart.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    apart = stored(apart.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("chunks", "other"), "apart")
    x, y = apart.alias("x"), apart.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    sides = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.chunk") != F.col("y.chunk"))
    met_again = x.join(y, same & sides & (F.col("x.component") < F.col("y.component")) & sketches_allow("x", "y"))
    more = met_again.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    more = stored(more.join(tried, ["a", "b"], "left_anti"), "more-pairs")
    if more.limit(1).count():
        new = stored(verified(more, rows, kinds), "more-links")
        found = connected_components(links.union(new)) if new.limit(1).count() else found
    for table in (met, tried, apart, more):
        drop_stored(table)

    joined = kinds.select("cls", "doc_id").join(found.withColumnRenamed("v", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(smallest, "component").select("cls", "component_id", "component")
    out = each.select("doc_id", "row_key", "n", "cls").join(named, "cls", "left")
    component = F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "component", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

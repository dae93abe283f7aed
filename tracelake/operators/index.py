"""Inverted index over documents, BM25 ranking, and what else reads the index."""

from __future__ import annotations

import functools
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.text import tokenize, words_of
from tracelake.operators.neighbours import rounded
from tracelake.sources.tables import new_path, remove, short_shuffles, stored

# Words never offered as co-terms.
STOP_WORDS = (
    "the", "and", "for", "this", "that", "with", "from", "was", "are", "not", "but", "has", "had", "have", "will",
    "been", "can", "its", "all", "also", "into", "our", "your", "com", "www", "http", "https",
)


#: Postings of one row of an index; those of a term and shard lie in order of falling impact.
BLOCK = 128
#: Postings of a bucket, as long as there are no more than MOST_BUCKETS of them; beyond that buckets grow.
BUCKET, MOST_BUCKETS = 1 << 18, 200_000
#: Documents of a shard, whose blocks a search scores together; postings that a task packs at once; rows it hands on at once.
SHARD, FLUSH, BATCH = 16_384, 1 << 22, 8192
#: Queries that a shard scores at once.
QUERIES = 256
#: Segments of an index before its smallest ones are put together.
MOST_SEGMENTS = 8
#: Terms of a query on average from which on all blocks are read at once, as few could be left out.
LONG_QUERY = 8
K1, B = 1.2, 0.75
#: Postings of a shard that a task of co-terms holds about at once; terms that tell which others may be among the first.
TOGETHER, LEADS = 1 << 21, 1000
#: Characters of a query in the automaton of a scan, and of all queries of one automaton.
HEAD, NEEDLES = 1000, 1 << 21


def _block_fields(kind: str) -> str:
    return f"term string, shard int, doc_ids array<{kind}>, tfs array<long>, dls array<long>, max_tf long, min_dl long"


def _read_blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Blocks of a segment; one without postings has no file to tell their schema."""
    return spark.read.schema(f"{_block_fields(kind)}, bucket int").parquet(f"{path}/blocks")


@dataclass(frozen=True)
class Segment:
    """One stored part of an index, with documents of its own.

    blocks (bucket, term, shard, doc_ids, tfs, dls, max_tf, min_dl): ranges of terms, a folder for each
    range, a block of documents of one shard; buckets (bucket, low, high): first and last term of each; docs (doc_id, dl);
    terms (term, df).
    """

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        if name != "blocks":
            return self.spark.read.parquet(f"{self.path}/{name}")
        return _read_blocks(self.spark, self.path, self.table("docs").schema["doc_id"].dataType.simpleString())

    def blocks(self, terms: DataFrame) -> DataFrame:
        """Blocks of the buckets that hold any of the terms; other files are not opened."""
        spans = self.table("buckets").orderBy("low", "high").collect()  # one row for each file of postings
        if not spans:
            return self.table("blocks").limit(0)
        lows, highs = (np.array([r[c] for r in spans], object) for c in ("low", "high"))

        @F.pandas_udf("array<int>")
        def buckets(term: pd.Series) -> pd.Series:
            first, last = np.searchsorted(highs, term, "left"), np.searchsorted(lows, term, "right")
            return pd.Series([list(range(x, y)) for x, y in zip(first, last, strict=True)])

        asked = terms.select(F.explode(buckets("term")).alias("place")).distinct().collect()  # no more than there are files
        wanted = sorted(spans[r["place"]]["bucket"] for r in asked)
        blocks = self.table("blocks")
        return blocks if len(wanted) == len(spans) else blocks.where(F.col("bucket").isin(*wanted) if wanted else F.lit(False))


@dataclass(frozen=True)
class Index:
    """Segments whose documents are disjoint; what they count apart is summed when it is read."""

    segments: tuple[Segment, ...]

    def _all(self, name: str) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, (s.table(name) for s in self.segments))

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf)."""
        each = self._all("blocks").select("term", F.explode(F.arrays_zip("doc_ids", "tfs")).alias("p"))
        return each.select("term", F.col("p.doc_ids").alias("doc_id"), F.col("p.tfs").alias("tf"))

    @property
    def docs(self) -> DataFrame:
        """(doc_id, dl) of documents with terms."""
        return self._all("docs")

    @property
    def terms(self) -> DataFrame:
        """(term, df)."""
        each = self._all("terms")
        return each if len(self.segments) == 1 else each.groupBy("term").agg(F.sum("df").alias("df"))

    @property
    def corpus(self) -> DataFrame:
        """One row (n, avgdl)."""
        return self.docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """Blocks of the segments, all or those of the terms' buckets, with `segment`, their number."""
        each = (s.table("blocks") if terms is None else s.blocks(terms) for s in self.segments)
        return functools.reduce(DataFrame.unionByName, (b.withColumn("segment", F.lit(i)) for i, b in enumerate(each)))


def postings(docs: DataFrame, text: Column | str = "text", **how) -> DataFrame:
    """(term, doc_id, tf, dl): term counts of each document and its length; a document without terms has no rows.

    A document is one row, so it is counted where it lies.
    """
    tokens = tokenize(F.col(text) if isinstance(text, str) else text, **how)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heap = _Postings(batch.schema.field("doc_id").type)
            for doc_id, words in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                heap.add(doc_id, words or ())
            yield from heap.rows()

    return docs.select("doc_id", tokens.alias("tokens")).mapInArrow(run, f"term string, doc_id {kind}, tf long, dl long")


class _Postings:
    """Postings of some documents in a task, terms as numbers."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.terms = kind, {}
        self.doc_ids: list = []
        self.shards, self.dls, self.sizes, self.codes, self.tfs = (array("q") for _ in range(5))

    def add(self, doc_id, words, shard: int = 0) -> None:
        counted = Counter(words)
        if counted:
            known = self.terms
            self.codes.extend([known.setdefault(w, len(known)) for w in counted])
            self.tfs.extend(counted.values())
            self.doc_ids.append(doc_id)
            self.shards.append(shard)
            self.dls.append(counted.total())
            self.sizes.append(len(counted))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(term, doc_id, tf, dl)."""
        if self.doc_ids:
            doc = np.repeat(np.arange(len(self.sizes)), np.asarray(self.sizes))
            yield pa.RecordBatch.from_arrays([pa.array(list(self.terms)).take(pa.array(np.asarray(self.codes))), pa.array(self.doc_ids, self.kind).take(pa.array(doc)), pa.array(np.asarray(self.tfs)), pa.array(np.asarray(self.dls)[doc])], ["term", "doc_id", "tf", "dl"])

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """Blocks of each term and shard, and one of all documents without a term."""
        if self.doc_ids:
            doc, dls = np.repeat(np.arange(len(self.sizes)), np.asarray(self.sizes)), np.asarray(self.dls)
            yield from _blocks(list(self.terms), np.asarray(self.codes), pa.array(self.doc_ids, self.kind), doc, np.asarray(self.shards)[doc], np.asarray(self.tfs), dls[doc])


BLOCK_COLUMNS = ["term", "shard", "doc_ids", "tfs", "dls", "max_tf", "min_dl"]


def _blocks(terms: list[str], code: np.ndarray, doc_ids: pa.Array, doc: np.ndarray, shard: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings as blocks of up to BLOCK in order of term, shard and falling impact; then the documents' lengths, term null."""
    place = np.empty(len(terms), np.int64)
    place[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    impact = tf / (tf + K1 * (1 - B + B * dl / dl.mean()))
    order = np.lexsort((doc, -impact, shard, place[code]))
    code, doc, shard, tf, dl = (x[order] for x in (code, doc, shard, tf, dl))
    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])])
    within = np.arange(len(code)) - np.repeat(new, np.diff(np.r_[new, len(code)]))
    starts = np.flatnonzero(within % BLOCK == 0)
    names, most, least = pa.array(terms, pa.string()), np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)
    for at in range(0, len(starts), BATCH):
        own = starts[at : at + BATCH]
        low, high = own[0], starts[at + BATCH] if at + BATCH < len(starts) else len(code)
        offsets = pa.array(np.r_[own, high] - low, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (doc_ids.take(pa.array(doc[low:high])), pa.array(tf[low:high]), pa.array(dl[low:high]))]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(code[own])), pa.array(shard[own], pa.int32()), *lists, pa.array(most[at : at + BATCH]), pa.array(least[at : at + BATCH])], BLOCK_COLUMNS)
    seen, first = np.unique(doc, return_index=True)
    for at in range(0, len(seen), BATCH):
        own = seen[at : at + BATCH]
        length, ends = pa.array(dl[first[at : at + BATCH]]), pa.array([0, len(own)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (doc_ids.take(pa.array(own)), length, length)]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int32()), *lists, pa.array([0]), pa.array([0])], BLOCK_COLUMNS)


def _sharded(rows: DataFrame, docs: int) -> DataFrame:
    """Rows with `shard`, each shard in a partition of its own: about SHARD documents, fewer where there would be less shards than cores."""
    n = max(1, -(-docs // SHARD), min(rows.sparkSession.sparkContext.defaultParallelism, -(-docs // 256)))
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartitionById(n, F.col("shard"))


def _packed_texts(docs: DataFrame, text: str, count: int, how: dict) -> DataFrame:
    """Blocks of texts that are cut, counted and packed in one pass of each shard, FLUSH postings at a time."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    said = (F.col(text) if not how else tokenize(F.col(text), **how)).alias("said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = None
        for batch in batches:
            heap = heap or _Postings(batch.schema.field("doc_id").type)
            for doc_id, words, shard in zip(batch.column("doc_id").to_pylist(), batch.column("said").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                heap.add(doc_id, () if words is None else words if how else words_of(words), shard)
                if len(heap.codes) >= FLUSH:
                    yield from heap.blocks()
                    heap = _Postings(heap.kind)
        if heap:
            yield from heap.blocks()

    return _sharded(docs.select("doc_id", said), count).mapInArrow(run, _block_fields(kind))


def _packed(counted: DataFrame) -> DataFrame:
    """Blocks of postings (term, doc_id, tf, dl)."""
    kind = counted.schema["doc_id"].dataType.simpleString()

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            word, doc = (table[c].combine_chunks().dictionary_encode() for c in ("term", "doc_id"))
            yield from _blocks(word.dictionary.to_pylist(), np.asarray(word.indices, np.int64), doc.dictionary, np.asarray(doc.indices, np.int64), *(np.asarray(table[c]) for c in ("shard", "tf", "dl")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= FLUSH:
                yield from pack(held)
                held, n = [], 0
        if held:
            yield from pack(held)

    docs = counted.agg(F.approx_count_distinct("doc_id").alias("n")).first()["n"]
    return _sharded(counted.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl")), docs).mapInArrow(run, _block_fields(kind))


def _write_packed(packed: DataFrame, path: str, bucket: int) -> Segment:
    """Store blocks as a segment, in ranges of terms of about `bucket` postings."""
    spark, kind = packed.sparkSession, packed.schema["doc_ids"].dataType.elementType.simpleString()
    with short_shuffles(spark):
        packed.write.mode("overwrite").parquet(f"{path}/packed")
        packed = spark.read.schema(packed.schema).parquet(f"{path}/packed")
        blocks = packed.where("term is not null")
        counts = blocks.groupBy("term").agg(F.sum(F.size("doc_ids")).alias("df"))
        counts.write.mode("overwrite").parquet(f"{path}/terms")
        total = spark.read.schema(counts.schema).parquet(f"{path}/terms").agg(F.sum("df").alias("n")).first()["n"] or 0
        ranges, order = min(MOST_BUCKETS, max(1, -(-total // bucket))), ["term", "shard", F.desc("max_tf"), "min_dl"]
        dealt = blocks.repartitionByRange(ranges, *order).sortWithinPartitions("term", "shard").withColumn("bucket", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        found = _read_blocks(spark, path, kind)
        found.groupBy("bucket").agg(F.min("term").alias("low"), F.max("term").alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets")
        each = packed.where("term is null").select(F.explode(F.arrays_zip("doc_ids", "dls")).alias("d"))
        each.groupBy(F.col("d.doc_ids").alias("doc_id")).agg(F.first("d.dls").alias("dl")).write.mode("overwrite").parquet(f"{path}/docs")
    remove(spark, f"{path}/packed")
    return Segment(spark, path)


def write_segment(counted: DataFrame, path: str, bucket: int = BUCKET) -> Segment:
    """Store postings (term, doc_id, tf, dl) as a segment."""
    spark = counted.sparkSession
    with short_shuffles(spark):
        counted.write.mode("overwrite").parquet(f"{path}/counted")
    segment = _write_packed(_packed(spark.read.schema(counted.schema).parquet(f"{path}/counted")), path, bucket)
    remove(spark, f"{path}/counted")
    return segment


def first_of_id(docs: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """(doc_id, text): of documents that share an id, the first by `order`, or without such a column the smallest text."""
    return docs.groupBy("doc_id").agg((F.min_by(text, order) if order in docs.columns else F.min(text)).alias(text))


def build_index(docs: DataFrame, text: str = "text", distinct: bool = False, path: str | None = None, bucket: int = BUCKET, **how) -> Index:
    """Index of (doc_id, text) in one segment, at `path` or in a new shared folder.

    Where ids repeat, the first document by the column `ord` counts, or without one that of
    the smallest text.  `distinct` says that ids don't repeat and saves the look at them; texts are shuffled only where
    some do.
    """
    if not distinct and docs.groupBy("doc_id").count().where("count > 1").limit(1).count():  # reads ids alone
        docs = first_of_id(docs, text)
    return Index((_write_packed(_packed_texts(docs, text, docs.count(), how), path or new_path(docs.sparkSession, "index"), bucket),))


def update_index(index: Index, new_docs: DataFrame, text: str = "text", most: int = MOST_SEGMENTS, path: str | None = None, **how) -> Index:
    """Index with documents added as a segment; ids it has already stay as they are.

    Of the index only the documents' table is read.  Beyond `most` segments the smaller half
    become one.
    """
    spark = new_docs.sparkSession
    fresh = first_of_id(new_docs, text).join(index.docs.select("doc_id"), "doc_id", "left_anti")
    added = write_segment(postings(fresh, text, **how), path or new_path(spark, "index"))
    return merge_segments(Index((*index.segments, added)), most)


def merge_segments(index: Index, most: int = MOST_SEGMENTS) -> Index:
    """Put the smaller half of the segments together once there are more than `most`; a document so moves a logarithmic number of times."""
    if len(index.segments) <= most:
        return index
    sized = sorted(index.segments, key=lambda s: s.table("docs").count())
    small, rest = Index(tuple(sized[: len(sized) - most // 2])), sized[len(sized) - most // 2 :]
    each = small._all("blocks").select("term", F.explode(F.arrays_zip("doc_ids", "tfs", "dls")).alias("p"))
    merged = write_segment(each.select("term", F.col("p.doc_ids").alias("doc_id"), F.col("p.dls").alias("dl"), F.col("p.tfs").alias("tf")), new_path(small.segments[0].spark, "index"))
    return Index((*rest, merged))


def query_terms(queries: DataFrame, text: str = "query", **how) -> DataFrame:
    """(query_id, term, qtf) of queries; `qtf` counts a term that stands more than once."""
    words = queries.select("query_id", F.explode(tokenize(F.col(text), **how)).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def begun_by(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of `asked` (prefix, ...) with each of the terms (term, ...) that the prefix begins.

    A term is cut to the lengths that prefixes have and joined on the whole prefix, so all that meets is a result.
    """
    lengths = sorted(r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect())  # one number for each length
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("term"))
    return asked.join(terms.withColumn("n", F.explode(fits)).withColumn("prefix", F.expr("substring(term, 1, n)")).drop("n"), "prefix")


def expand_wildcards(queries: DataFrame, terms: DataFrame, text: str = "query", most: int | None = None) -> DataFrame:
    """(query_id, term, qtf): `pre*` (two characters or more) stands for all terms with the prefix, or for itself without any.

    `most` keeps the first terms in order, as the command-line dialect does.
    """
    words = queries.select("query_id", F.explode(F.split(F.lower(F.col(text)), r"[^a-z0-9*]+")).alias("word")).where("word <> ''").distinct()
    wild = F.col("word").endswith("*") & (F.length("word") > 2)
    stems = words.where(wild).withColumn("prefix", F.regexp_replace("word", r"\*", "")).where(F.length("prefix") >= 2)
    found = begun_by(stems, terms.select("term"))
    if most is not None:
        found = found.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "word").orderBy("term"))).where(F.col("rn") <= most)
    found = found.select("query_id", "word", "term")
    bare = stems.join(found.select("query_id", "word").distinct(), ["query_id", "word"], "left_anti").select("query_id", F.col("prefix").alias("term"))
    plain = words.where(~wild).select("query_id", F.regexp_replace("word", r"\*", "").alias("term")).where("term <> ''")
    return found.select("query_id", "term").union(bare).union(plain).distinct().withColumn("qtf", F.lit(1).cast("long"))


def _weighed(index: Index, terms: DataFrame) -> DataFrame:
    """Query terms (query_id, term, qtf) with idf and avgdl; those in half of the documents or more weigh nothing and leave."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(index.terms, "term").crossJoin(F.broadcast(index.corpus)).withColumn("idf", idf).where("idf > 0")  # corpus is one row


def _part(tf: Column, dl: Column, k1: float, b: float) -> Column:
    return F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def _sums(blocks: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score) summed over the postings of blocks that stand beside query terms."""
    each = blocks.select("query_id", "qtf", "idf", "avgdl", F.explode(F.arrays_zip("doc_ids", "tfs", "dls")).alias("p"))
    return each.select("query_id", F.col("p.doc_ids").alias("doc_id"), _part(F.col("p.tfs"), F.col("p.dls"), k1, b).alias("part")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def _scores(asked: DataFrame, blocks: DataFrame, k1: float, b: float, n: int | None = None, digits: int = 5) -> DataFrame:
    """(query_id, doc_id, score) over 0 of query terms (query_id, term, qtf, idf, avgdl), summed over the postings of blocks.

    The blocks of a shard come together as they are, each once for about QUERIES queries, and the scores
    of its documents are summed there.  With n, only a query's first n by rounded score and id leave a shard.
    """
    parts = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
    by_term = asked.groupBy("term", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("query_id", (F.col("qtf") * F.col("idf")).alias("w"))).alias("asked"), F.first("avgdl").alias("avgdl"))
    beside = blocks.join(by_term, "term").select("segment", "shard", "part", "term", "doc_ids", "tfs", "dls", "avgdl", F.col("asked.query_id").alias("query_ids"), F.col("asked.w").alias("ws"))
    query_kind, doc_kind = asked.schema["query_id"].dataType.simpleString(), blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def score(table: pa.Table) -> pa.Table:
        return _shard_scores(table, k1, b, n, digits)

    return beside.groupBy("segment", "shard", "part").applyInArrow(score, f"query_id {query_kind}, doc_id {doc_kind}, score double")


def _shard_scores(table: pa.Table, k1: float, b: float, n: int | None, digits: int) -> pa.Table:
    """The scores of one shard's documents for some queries."""
    table = table.combine_chunks()
    flat = lambda c: pc.list_flatten(table[c]).combine_chunks()
    term, doc, query = table["term"].combine_chunks().dictionary_encode(), flat("doc_ids").dictionary_encode(), flat("query_ids").dictionary_encode()
    tf, dl = np.asarray(flat("tfs")), np.asarray(flat("dls"))
    sizes = np.asarray(pc.list_value_length(table["doc_ids"]))
    code = np.repeat(np.asarray(term.indices), sizes)
    base = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / np.repeat(np.asarray(table["avgdl"]), sizes)))
    order = np.argsort(code, kind="stable")
    place, base, ends = np.asarray(doc.indices)[order], base[order], np.r_[0, np.cumsum(np.bincount(code, minlength=len(term.dictionary)))]
    each = np.asarray(pc.list_value_length(table["query_ids"]))
    _, first = np.unique(np.asarray(term.indices), return_index=True)
    starts, which, ws = np.r_[0, np.cumsum(each)], np.asarray(query.indices), np.asarray(flat("ws"))
    sums = np.zeros((len(query.dictionary), len(doc.dictionary)))
    for t, row in enumerate(first.tolist()):
        own, part = place[ends[t] : ends[t + 1]], base[ends[t] : ends[t + 1]]
        for i in range(starts[row], starts[row + 1]):
            sums[which[i]][own] += ws[i] * part  # a term has a document once
    out = []
    for q, s in enumerate(sums):
        if n is None or np.count_nonzero(s > 0) <= n:
            best = np.flatnonzero(s > 0)
        else:
            least = np.partition(s, len(s) - n)[len(s) - n]
            near = np.flatnonzero((s > 0) & (s >= least - 2 * 10.0**-digits))
            ranked = pa.table({"score": rounded(s[near], digits), "doc_id": doc.dictionary.take(pa.array(near))})
            best = near[np.asarray(pc.sort_indices(ranked, [("score", "descending"), ("doc_id", "ascending")]))[:n]]
        out.append((np.full(len(best), q), best, s[best]))
    q, d, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query_id": query.dictionary.take(pa.array(q)), "doc_id": doc.dictionary.take(pa.array(d)), "score": s})


def bm25(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of all documents with a positive score for query terms (query_id, term, qtf)."""
    weighed = stored(_weighed(index, terms), "query-terms")
    return _scores(weighed, index.blocks(weighed.select("term").distinct()), k1, b)


def bm25_top(index: Index, terms: DataFrame, n: int, k1: float = K1, b: float = B, digits: int = 5, long_query: float = LONG_QUERY) -> DataFrame:
    """(query_id, doc_id, score, rank) of the first n of `rank_hits`.

    Queries of more than LONG_QUERY terms on average are scored from all blocks of their terms; shards rank on
    their own, and only their first n are ranked together.  For shorter ones the best block of each term gives
    n documents a score that their full one cannot fall below; the n-th of these is the query's bar.  A block is
    left out if its best possible part and those of the query's other terms stay below the bar: none of its documents is among the first n.
    """
    weighed = stored(_weighed(index, terms), "query-terms")
    blocks = index.blocks(weighed.select("term").distinct())
    size = weighed.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("query_id").alias("queries")).first()
    if size["terms"] > long_query * size["queries"]:
        return rank_hits(_scores(weighed, blocks, k1, b, n, digits), n, digits=digits)
    found = weighed.join(blocks, "term").withColumn("bound", _part(F.col("max_tf"), F.col("min_dl"), k1, b))
    best = found.groupBy("query_id", "term").agg(F.max("bound").alias("most"))
    whole = best.groupBy("query_id").agg(F.sum("most").alias("whole"))
    lead = _sums(found.join(best, ["query_id", "term"]).where("bound = most").drop("most"), k1, b)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    bar = lead.withColumn("place", place).where(F.col("place") == n).select("query_id", F.col("score").alias("bar"))
    limits = stored(best.join(whole, "query_id").join(bar, "query_id", "left").select("query_id", "term", (F.col("whole") - F.col("most")).alias("others"), F.coalesce("bar", F.lit(0.0)).alias("bar")), "limits")
    kept = found.join(limits, ["query_id", "term"]).where(F.col("bound") + F.col("others") >= F.col("bar") - 10.0**-digits)
    return rank_hits(_sums(kept, k1, b).where("score > 0"), n, digits=digits)


def search(docs: DataFrame, queries: DataFrame, idf_scope: str = "global", keep: Column | None = None, text: str = "text", query: str = "query") -> DataFrame:
    """BM25 over documents; `keep` filters them after (`global`) or before (`filtered`) the index counts terms."""
    if idf_scope == "filtered" and keep is not None:
        return bm25(build_index(docs.where(keep), text), query_terms(queries, query))
    found = bm25(build_index(docs, text), query_terms(queries, query))
    return found if keep is None else found.join(docs.where(keep).select("doc_id"), "doc_id", "left_semi")


def rank_hits(hits: DataFrame, n: int | None = None, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "doc_id", digits: int = 5) -> DataFrame:
    """Rank from 1 by rounded score, then id; only the first n if given."""
    rounded = hits.withColumn(score, F.round(score, digits))
    ranked = rounded.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def autocomplete(terms: DataFrame, prefixes: DataFrame, n: int = 8) -> DataFrame:
    """(prefix, term, df, rank): the commonest terms longer than a prefix of two characters or more."""
    clean = prefixes.select(F.regexp_replace(F.lower("prefix"), "[^a-z0-9]", "").alias("prefix")).where(F.length("prefix") >= 2).distinct()
    found = begun_by(clean, terms.select("term", "df")).where("term <> prefix")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("df"), "term"))
    return found.select("prefix", "term", "df", rank.alias("rank")).where(F.col("rank") <= min(n, 20))


def coterms(index: Index, keywords: DataFrame, n: int = 6, share: float = 0.05) -> DataFrame:
    """(keyword, term, co, score, rank): other terms of a keyword's documents, common ones weighed down.

    Terms of under three letters, stop words, and those of one document or of `share` of
    all documents leave first.  The blocks of a shard come together and its documents are counted there.  A term
    scores its count in all documents over its weight at most: the n-th score among the LEADS terms with the highest such
    bounds is a keyword's bar, and no pair of it with a term whose bound stays below leaves a shard.
    """
    n = min(n, 20)
    blocks = index.blocks().select("segment", "shard", "term", "doc_ids", "tfs")
    tf = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    counted = blocks.groupBy("term").agg(F.sum(F.size("doc_ids")).alias("df"), F.sum(tf).alias("cf")).crossJoin(F.broadcast(index.corpus))
    offered = (F.length("term") > 2) & ~F.col("term").isin(*STOP_WORDS) & (F.col("df") > 1) & (F.col("df") < F.col("n") * share)
    allowed = stored(counted.where(offered).select("term", "df", (F.col("cf") / F.log2(F.col("df") + 1)).alias("bound")), "offered-terms")
    size = allowed.crossJoin(F.broadcast(index.corpus)).agg(F.sum("df").alias("postings"), F.max("n").alias("docs")).first()
    parts = max(1, -(-(size["postings"] or 0) // (TOGETHER * max(1, (size["docs"] or 0) // SHARD))))
    clean = stored(keywords.select(F.regexp_replace(F.lower("keyword"), "[^a-z0-9]", "").alias("term")).where("term <> ''").distinct(), "keywords")
    inside = index.blocks(clean).join(clean, "term").select("segment", "shard", F.col("term").alias("keyword"), "doc_ids")

    def first(terms: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
        sums = _together(asked, blocks.join(terms, "term"), parts).where("term <> keyword").groupBy("keyword", "term").agg(F.sum("co").alias("co"), F.max("df").alias("df"))
        scored = sums.withColumn("score", F.round(F.col("co") / F.log2(F.col("df") + 1), 5))
        rank = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("score"), "term"))
        return scored.select("keyword", "term", "co", "score", rank.alias("rank")).where(F.col("rank") <= n)

    leads = allowed.orderBy(F.desc("bound"), "term").limit(LEADS)
    bars = stored(first(leads, inside.withColumn("bar", F.lit(0.0)), 1).where(F.col("rank") == n).select("keyword", F.col("score").alias("bar")), "bars")
    return first(allowed, inside.join(bars, "keyword", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0))), parts)


def _together(asked: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """(keyword, term, df, co) counted in each shard: occurrences of terms in the documents of keywords, of pairs whose bound reaches the bar."""
    keys = ["segment", "shard", "part"]
    ours = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    theirs = blocks.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    return ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(_shard_together, "keyword string, term string, df long, co long")


def _shard_together(asked: pa.Table, blocks: pa.Table) -> pa.Table:
    """The pairs of one shard, from blocks of keywords (keyword, doc_ids, bar) and of terms (term, doc_ids, tfs, df, bound)."""
    if not asked.num_rows or not blocks.num_rows:
        return pa.table({"keyword": pa.array([], pa.string()), "term": pa.array([], pa.string()), "df": pa.array([], pa.int64()), "co": pa.array([], pa.int64())})
    flat = lambda t, c: pc.list_flatten(t[c]).combine_chunks()
    sizes = lambda t: np.asarray(pc.list_value_length(t["doc_ids"]))
    asked, blocks = asked.combine_chunks(), blocks.combine_chunks()
    word, term = asked["keyword"].combine_chunks().dictionary_encode(), blocks["term"].combine_chunks().dictionary_encode()
    doc = flat(asked, "doc_ids").dictionary_encode()
    held = np.asarray(pc.fill_null(pc.index_in(flat(blocks, "doc_ids"), value_set=doc.dictionary), -1))
    mine = held >= 0  # documents without a keyword leave
    code, tf, held = np.repeat(np.asarray(term.indices), sizes(blocks))[mine], np.asarray(flat(blocks, "tfs"))[mine], held[mine]
    order = np.argsort(held, kind="stable")
    code, tf = code[order], tf[order].astype(np.float64)
    counts = np.bincount(held, minlength=len(doc.dictionary))
    starts = np.cumsum(counts) - counts
    bound, df = np.zeros(len(term.dictionary)), np.zeros(len(term.dictionary), np.int64)
    bound[np.asarray(term.indices)], df[np.asarray(term.indices)] = np.asarray(blocks["bound"]), np.asarray(blocks["df"])
    bar = np.zeros(len(word.dictionary))
    bar[np.asarray(word.indices)] = np.asarray(asked["bar"])
    owner = np.repeat(np.asarray(word.indices), sizes(asked))
    docs = np.asarray(doc.indices)[np.argsort(owner, kind="stable")]
    ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(bar)))]
    words, terms, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for w in range(len(bar)):
        own = docs[ends[w] : ends[w + 1]]
        n = counts[own]
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if len(at) < len(bound):
            met, place = np.unique(code[at], return_inverse=True)
            co = np.bincount(place, tf[at], len(met))
        else:
            co = np.bincount(code[at], tf[at], len(bound))
            met = np.flatnonzero(co)
            co = co[met]
        kept = bound[met] >= bar[w] - 2e-5  # scores are rounded to five digits
        words.append(np.full(np.count_nonzero(kept), w))
        terms.append(met[kept])
        sums.append(co[kept])
    w, t, co = (np.concatenate(x) for x in (words, terms, sums))
    return pa.table({"keyword": word.dictionary.take(pa.array(w)), "term": term.dictionary.take(pa.array(t)), "df": df[t], "co": co.astype(np.int64)})


def substring_scan(docs: DataFrame, queries: DataFrame, per_source: int | None = 20, excerpt: int = 150, block: int = NEEDLES) -> DataFrame:
    """(query_id, source, doc_id, excerpt, rank): texts that contain a query, whatever the case, unranked; a baseline.

    One automaton of all queries reads each text once, whatever their number.  It holds the first
    HEAD characters of a query; a longer one is looked for in the texts that hold these.  Queries of more than
    `block` characters in all, heads counted, are dealt into several automata, each a scan.  Null and
    empty queries, and null texts, match nothing.
    """
    asked = queries.select("query_id", F.lower("query").alias("needle")).where(F.length("needle") > 0)
    size = asked.agg(F.sum(F.least(F.length("needle"), F.lit(HEAD))).alias("n")).first()["n"] or 0
    scans, kind = max(1, -(-size // block)), queries.schema["query_id"].dataType.simpleString()
    lines = docs.select("doc_id", "source", F.substring("text", 1, excerpt).alias("excerpt"), F.lower("text").alias("line"))
    out = None
    for scan in range(scans):
        held = asked.where(F.pmod(F.xxhash64("query_id", "needle"), F.lit(scans)) == scan)
        # whole queries, those of one block; beyond their heads they are as long as the queries themselves
        needles = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in held.collect()])
        found = lines.select("doc_id", "source", "excerpt", F.explode(_held_in(needles, kind)(F.col("line"))).alias("query_id"))
        out = found if out is None else out.union(found)
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("doc_id"))
    ranked = out.select("query_id", "source", "doc_id", "excerpt", rank.alias("rank"))
    return ranked if per_source is None else ranked.where(F.col("rank") <= per_source)


def contained(lines: DataFrame, text: str, needles: DataFrame, needle: str, block: int = NEEDLES) -> DataFrame:
    """(needle): the distinct needles that some line's text contains, letter for letter; null and empty ones never.

    Automata of `block` characters of needles read the lines, as in `substring_scan`.
    """
    asked = stored(needles.select(F.col(needle).alias("needle")).where(F.length("needle") > 0).distinct(), "needles")
    size = asked.agg(F.sum(F.least(F.length("needle"), F.lit(HEAD))).alias("n")).first()["n"] or 0
    scans, out = max(1, -(-size // block)), None
    for scan in range(scans):
        # whole needles, those of one block
        held = [(r["needle"], r["needle"]) for r in asked.where(F.pmod(F.xxhash64("needle"), F.lit(scans)) == scan).collect()]
        found = lines.select(F.explode(_held_in(lines.sparkSession.sparkContext.broadcast(held), "string")(F.col(text))).alias(needle))
        out = found if out is None else out.union(found)
    return out.distinct()


def _automaton(needles: list[tuple]) -> ahocorasick.Automaton:
    by_head: dict[str, list[tuple]] = {}
    for needle_id, needle in needles:
        by_head.setdefault(needle[:HEAD], []).append((needle_id, needle))
    words = ahocorasick.Automaton()
    for head, own in by_head.items():
        words.add_word(head, own)
    words.make_automaton()
    return words


def _held_in(needles, kind: str):
    """Ids of the needles (id, text) that a text holds, one for each needle."""

    @F.pandas_udf(f"array<{kind}>")
    def held(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _automaton(needles.value)  # once for a task

        def ids(line: str | None) -> list:
            met = {id(own): own for _, own in words.iter(line)} if line and needles.value else {}
            return [needle_id for own in met.values() for needle_id, needle in own if len(needle) <= HEAD or needle in line]

        for batch in lines:
            yield batch.map(ids)

    return held


def find_in_messages(messages: DataFrame, terms: str, by_message: bool = False) -> DataFrame:
    """(session_id, n_matches): messages that hold any of the words of three letters or more.

    `by_message` gives (session_id, ordinal, matches, spans) of every message instead:
    whether it holds one, and each whole word's (word, start from 1) in order, for marking.
    """
    words = list(dict.fromkeys(w.lower() for w in terms.split() if len(w) >= 3))
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    if not by_message:
        return messages.where(hit).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_matches"))
    found, gaps = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), F.split(low, "[a-z0-9]+")
    # the place of each word: the words and gaps before it
    place = F.transform(found, lambda w, i: F.struct(w.alias("word"), (F.aggregate(F.slice(found, F.lit(1), i), F.lit(1), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x))).alias("start")))
    return messages.select("session_id", "ordinal", hit.alias("matches"), F.filter(place, lambda p: p["word"].isin(*words) if words else F.lit(False)).alias("spans"))

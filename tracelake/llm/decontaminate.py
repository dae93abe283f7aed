"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size, [2^j, 2^(j+1)) shingles.  The MinHash sketch of an
item is the bottom of its shingles in hash order.  An item of n shingles that is
contained to 0.8 in a document misses at most n - ceil(0.8 n) of them, so among
its `missing + need` smallest at least `need` are in the document, however long
that is; `need` is fixed for each partition and grows with it.  Documents with
that many sketch values of an item are candidates, and the candidates are checked
by the exact texts of all the item's shingles.  No contained item is missed.  An item
of fewer than five words is one shingle of its own length, sought at all places.

Documents are read once.  A Bloom filter over the items' shingles, whose size has
a fixed upper bound, decides which of a document's shingles leave the scan; when
the test set outgrows it, more rows pass and the joins remove them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.kernels import _STEP, SHINGLE_WORDS, blocks, mix, shingles, utf8, word_hashes, word_spans
from tracelake.llm.shared import stored

PERCENT = 80
BITS_PER_SHINGLE = 32
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
_U = np.uint64


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & _U(bits - 1)).astype(np.int64), (mix(h) & _U(bits - 1)).astype(np.int64)


def _joined(raw: bytes) -> str:
    """Words of a piece of text, A-Z lower-cased, with single spaces; bytes.split and bytes.lower know ASCII only."""
    return b" ".join(w for w in raw.lower().split() if w).decode("utf-8", "replace")


def short_runs(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k < SHINGLE_WORDS words within a row, as an item of k words has, and their first words."""
    start = np.arange(max(0, len(words) - k + 1))
    whole = np.full(len(start), k, np.uint64)
    for j in range(k):
        whole += words[j : len(start) + j] * _STEP[j]
    inside = start + k <= rows[np.searchsorted(rows, start, "right")]
    return mix(whole[inside]), start[inside]


def _rows(columns: str, filter_bytes=None, short=()):
    """Batches of `columns` to rows (columns, n, words, h, shingle): each distinct shingle that the filter lets through.

    With `short`, runs of these numbers of words are shingles too.
    """
    names = columns.split()

    def run(batches):
        table = None if filter_bytes is None else np.unpackbits(filter_bytes.value, bitorder="little").view(bool)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in blocks(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, rows = word_spans(part, own)
                words = word_hashes(part, starts, ends)
                h, of = shingles(words, rows)
                own_row = np.repeat(np.arange(b - a), np.diff(of))
                first = rows[own_row] + np.arange(len(h)) - of[own_row]
                size = np.minimum(np.diff(rows)[own_row], SHINGLE_WORDS)
                for k in short:
                    more, at = short_runs(words, rows, k)
                    h, first, size = np.concatenate([h, more]), np.concatenate([first, at]), np.concatenate([size, np.full(len(at), k)])
                if table is not None:
                    i, j = _positions(h, len(table))
                    hit = np.flatnonzero(table[i] & table[j])
                    h, first, size = h[hit], first[hit], size[hit]
                row = np.searchsorted(rows, first, "right") - 1
                order = np.lexsort((h, row))
                h, first, size, row = h[order], first[order], size[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                h, first, size, row = h[new], first[new], size[new], row[new]
                if not len(h):
                    continue
                text = [_joined(part[x:y].tobytes()) for x, y in zip(starts[first].tolist(), ends[first + size - 1].tolist(), strict=True)]
                taken = batch.slice(a, b - a).select(names).take(pa.array(row))
                n = np.diff(of)[row] if table is not None else np.bincount(row, minlength=b - a)[row]
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(n.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(text)], [*names, "n", "words", "h", "shingle"])

    return run


def _bit_rows(bits: int):
    """Batches with h to the 64-bit words of the filter that they set."""

    def run(batches):
        for batch in batches:
            at = np.concatenate(_positions(np.asarray(batch.column("h")).view(np.uint64), bits))
            filled = np.zeros(bits, np.uint8)
            filled[at] = 1
            words = np.packbits(filled, bitorder="little").view(np.int64)
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    return run


def shingle_filter(shingles_of_items: DataFrame) -> np.ndarray:
    """Bytes of a Bloom filter over column h: at most MOST_BITS / 8 of them, whatever the number of rows."""
    n = shingles_of_items.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_PER_SHINGLE):
        bits *= 2
    words = np.zeros(bits // 64, np.int64)
    found = shingles_of_items.select("h").mapInArrow(_bit_rows(bits), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    for batch in found.toArrow().to_batches():  # MOST_BITS / 64 rows at most
        words[np.asarray(batch.column("at"))] = np.asarray(batch.column("word"))
    return words.view(np.uint8)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of documents that contain an item to 0.8 or more.

    Containment is the share of the item's distinct five-word shingles that the
    document has, wherever they stand in it.  Items and documents without words
    match nothing; an item of one to four words is one shingle, which a document has
    where these words stand one after the other.  Rows that repeat give the pair once; null ids are
    values like others; other columns are ignored; empty tables give no rows.
    """
    return contaminated_rows(docs, items).drop("row_key").distinct()


def contaminated_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of `contaminated` with row_key, the hash of id and text."""
    spark = docs.sparkSession
    item_kind, doc_kind = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    own = stored(
        items.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), "text")
        .mapInArrow(_rows("item_id item_key"), f"item_id {item_kind}, item_key long, n long, words int, h long, shingle string")
        .distinct(),
        "item-shingles",
    )
    shared = spark.sparkContext.broadcast(shingle_filter(own))
    short = [r["words"] for r in own.select("words").where(F.col("words") < SHINGLE_WORDS).distinct().collect()]  # SHINGLE_WORDS - 1 at most
    hits = stored(
        docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
        .mapInArrow(_rows("doc_id row_key", shared, short), f"doc_id {doc_kind}, row_key long, n long, words int, h long, shingle string")
        .drop("words")
        .distinct(),
        "document-hits",
    )

    partition = F.floor(F.log2(F.col("n").cast("double")))
    need = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.pow(F.lit(2.0), partition) / 4))).cast("long")
    least = F.ceil(F.col("n") * PERCENT / 100)
    sketch = (
        own.withColumn("need", need)
        .withColumn("rank", F.row_number().over(Window.partitionBy("item_key").orderBy("h")))
        .where(F.col("rank") <= F.col("n") - least + F.col("need"))
        .select("item_key", "h", "need", least.alias("least"))
    )
    candidates = (
        hits.join(sketch, "h")
        .where("n >= least")
        .groupBy("row_key", "item_key")
        .agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need"))
        .where("met >= need")
        .select("row_key", "item_key")
    )
    wanted = candidates.join(own.select("item_id", "item_key", F.col("n").alias("n_shingles"), "shingle"), "item_key")
    counted = (
        wanted.join(hits.select("row_key", "doc_id", "shingle"), ["row_key", "shingle"])
        .groupBy("row_key", "item_key")
        .agg(F.min("doc_id").alias("doc_id"), F.min("item_id").alias("item_id"), F.min("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n_shared"))
    )
    return (
        counted.where(F.col("n_shared") * 100 >= F.col("n_shingles") * PERCENT)
        .select("doc_id", "row_key", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    )


ORACLE = """
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') FROM benchmark
), k AS (SELECT DISTINCT least(len(l), 5) AS k FROM w WHERE kind = 1 AND len(l) > 0
), s AS (
  SELECT DISTINCT kind, id, array_to_string(l[i : i + k - 1], ' ') AS g
  FROM (SELECT kind, id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM w JOIN k ON k <= len(l) AND (kind = 0 OR k = least(len(l), 5)))
), t AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n FROM s WHERE kind = 1)
SELECT s.id AS doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM t JOIN s USING (g) WHERE kind = 0 GROUP BY s.id, item_id, n HAVING 100 * count(*) >= 80 * n
"""

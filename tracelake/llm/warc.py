"""WARC records and a Merkle fixity audit of two replicas.

The leaves of a tree are the records of a file with their offsets, lengths and
digests; inner nodes hash ordered ranges of FANOUT children; files are ranges of
record ids.  The audit compares the roots and goes down only where they differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import stored

FANOUT = 16
IDS_PER_FILE = 1000
FILES_WITHOUT_ID = 4096
DATE = "2024-01-01T00:00:00Z"


def _records(pages: DataFrame, ids_per_file: int) -> DataFrame:
    """(page_id, file, length, record), without a shuffle."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    records = pages.select("page_id", F.concat(F.encode(head, "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))
    without_id = -1 - F.pmod(F.xxhash64("record"), F.lit(FILES_WITHOUT_ID))
    file = F.coalesce(F.floor(F.col("page_id") / ids_per_file).cast("long"), without_id)
    return records.select("page_id", file.alias("file"), F.octet_length("record").cast("long").alias("length"), "record")


def _placed(rows: DataFrame, digest) -> DataFrame:
    """Rows (page_id, file, length, ...) with their place and offset in the file."""
    order = Window.partitionBy("file").orderBy("page_id", digest)
    return rows.withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn(
        "offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    )


def warc_records(pages: DataFrame, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """(page_id, file, length, record, place, offset): one WARC resource record for each page, for writing files.

    Files hold ranges of `ids_per_file` ids; records stand in order of page_id, then
    of their digest.  A null url or html is empty, records of null ids are dealt over
    FILES_WITHOUT_ID files of negative numbers.
    """
    return _placed(_records(pages, ids_per_file), F.sha2("record", 256))


def warc_digests(pages: DataFrame, damaged=None, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """(page_id, file, length, sha256, replica_sha256, place, offset) of the records of `warc_records`.

    Bodies are hashed where they are read, and only digests are put in order.  The
    replica has one byte of the records inverted where `damaged` holds.
    """
    digest, hurt = F.sha2("record", 256), F.sha2(flipped(F.col("record"), F.col("length")), 256)
    replica = digest if damaged is None else F.when(damaged, hurt).otherwise(digest)
    return _placed(_records(pages, ids_per_file).select("page_id", "file", "length", digest.alias("sha256"), replica.alias("replica_sha256")), F.col("sha256"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(name, place, offset, length, record) of uncompressed WARC files; a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, place, out = 0, 0, []
                while at < len(content):
                    body = content.index(b"\r\n\r\n", at) + 4
                    size = next(int(line.split(b":", 1)[1]) for line in content[at:body].split(b"\r\n") if line.lower().startswith(b"content-length:"))
                    out.append((name, place, at, body + size + 4 - at, content[at : body + size + 4]))
                    at, place = body + size + 4, place + 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["name", "place", "offset", "length", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "name string, place long, offset long, length long, record binary")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0 of the tree: (file, level, place, hash, page_id, offset, length), from the records or their sha256."""
    digest = F.col("sha256") if "sha256" in records.columns else F.sha2(F.col("record"), 256)
    return records.select("file", F.lit(0).alias("level"), "place", F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), digest), 256).alias("hash"), "page_id", "offset", "length")


def parents(nodes: DataFrame, level: int, *group: str) -> DataFrame:
    """Hashes of ordered ranges of FANOUT nodes."""
    place = F.floor(F.col("place") / FANOUT).cast("long").alias("place")
    children = F.array_sort(F.collect_list(F.struct("place", "hash")))
    ranges = nodes.groupBy(*group, place).agg(children.alias("children"))
    return ranges.select(*group, F.lit(level).alias("level"), "place", F.sha2(F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["place"].cast("string"), c["hash"])), "|"), 256).alias("hash"))


def merkle_levels(records: DataFrame, first_file: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of the files' trees from the leaves up, and levels of the tree over all files, whose last is one node."""
    trees = [stored(leaves(records), "merkle")]
    most = trees[0].agg(F.coalesce(F.max("place"), F.lit(0)).alias("place"), F.coalesce(F.max("file"), F.lit(first_file)).alias("file")).first()
    span = most["place"]
    while span > 0:
        trees.append(stored(parents(trees[-1], len(trees), "file"), "merkle"))
        span //= FANOUT
    over = [trees[-1].select((F.col("file") - first_file).alias("place"), "hash")]
    span = most["file"] - first_file
    while span > 0:
        over.append(stored(parents(over[-1], len(over)), "merkle"))
        span //= FANOUT
    return trees, over


def _even(a: list[DataFrame], b: list[DataFrame], *group: str) -> None:
    """Give the lower of two trees further levels of one node each."""
    while len(a) != len(b):
        lower = min(a, b, key=len)
        lower.append(stored(parents(lower[-1], len(lower), *group), "merkle"))


def _differ(left: DataFrame, right: DataFrame, keys: list[str], under: DataFrame | None) -> DataFrame:
    """Nodes whose hashes differ or that one side lacks, among the children of `under`."""
    if under is not None:
        chosen = under.select(*[F.col(k).alias(f"of_{k}") for k in keys])
        child = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys if k != "place"] + [F.floor(F.col("place") / FANOUT) == F.col("of_place")]
        left, right = left.join(chosen, child, "left_semi"), right.join(chosen, child, "left_semi")
    both = left.select(*keys, F.col("hash").alias("l")).join(right.select(*keys, F.col("hash").alias("r")), keys, "full")
    fault = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("changed")
    return stored(both.where(~F.col("l").eqNullSafe(F.col("r"))).select(*keys, fault.alias("fault")), "differ")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, place, fault) of the records that differ between two sets of records (file, place, offset, length, record).

    `fault` is changed, missing (not in the replica) or extra.  Equal roots end the
    audit at once; otherwise each level is compared only under nodes that differ.
    Two empty sets have no faults.
    """
    first = primary.select("file").union(replica.select("file")).agg(F.coalesce(F.min("file"), F.lit(0)).alias("f")).first()["f"]
    (a_trees, a_files), (b_trees, b_files) = merkle_levels(primary, first), merkle_levels(replica, first)
    _even(a_trees, b_trees, "file")
    a_files[0], b_files[0] = (t[-1].select((F.col("file") - first).alias("place"), "hash") for t in (a_trees, b_trees))
    _even(a_files, b_files)
    under = None
    for a, b in zip(reversed(a_files), reversed(b_files), strict=True):
        under = _differ(a, b, ["place"], under)
        if not under.limit(1).count():
            return under.select(F.col("place").alias("file"), "place", "fault")
    files = under.select((F.col("place") + first).alias("file"))
    under = None
    for a, b in zip(reversed(a_trees), reversed(b_trees), strict=True):
        under = _differ(a.join(files, "file", "left_semi"), b.join(files, "file", "left_semi"), ["file", "place"], under)
    return under


def flipped(record: Column, length: Column) -> Column:
    """A record with its middle byte inverted."""
    middle = F.floor(length / 2).cast("int")
    byte = F.conv(F.hex(F.substring(record, middle, 1)), 16, 10).cast("int")
    other = F.unhex(F.lpad(F.hex((F.lit(255) - byte).cast("long")), 2, "0"))
    return F.concat(F.substring(record, 1, middle - 1), other, F.substring(record, middle + 1, length.cast("int")))


def flip_byte(records: DataFrame, damaged) -> DataFrame:
    """Records of which the middle byte is inverted where `damaged` holds."""
    return records.withColumn("record", F.when(damaged, flipped(F.col("record"), F.col("length"))).otherwise(F.col("record")))


def fixity(records: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, file, offset, length, sha256, fault) of every record of `records`; fault is null where the replica agrees.

    Both tables hold records or their sha256.  Records of equal ids are told apart by
    their place; an empty table gives no rows.
    """
    faults = audit(records, replica)
    digest = F.col("sha256") if "sha256" in records.columns else F.sha2("record", 256).alias("sha256")
    own = records.select("page_id", "file", "place", "offset", "length", digest)
    return own.join(faults, ["file", "place"], "left").select("page_id", "file", "offset", "length", "sha256", "fault")


ORACLE = f"""
WITH r AS (
  SELECT page_id, page_id // {IDS_PER_FILE} AS file,
    'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Date: {DATE}' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
    || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e
    || coalesce(html, '') || e || e AS record
  FROM pages, (SELECT chr(13) || chr(10) AS e)
)
SELECT page_id, file, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       strlen(record) AS length, sha256(record) AS sha256, CASE WHEN page_id % 97 = 5 THEN 'changed' END AS fault
FROM r
"""

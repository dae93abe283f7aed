"""Removal of repeated passages by overlapping windows of three lines; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_LINES = 3
_WORD = r"[^\x09-\x0D\x20]"


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Starts (from 1) of the windows that occur earlier, by (doc_id, line), in this or another document.

    Returns (id, key, starts): key is a hash of id and text that tells apart rows
    with a null or repeated id.  Texts of one or two lines have no window; windows
    without a word are left out.  Two 64-bit hashes name a window.
    """
    lines = F.split(F.col(text), "\n")
    windows = (
        docs.where(F.col(text).rlike(_WORD))
        .select(F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("key"), lines.alias("lines"), (F.size(lines) - (WINDOW_LINES - 1)).alias("last"))
        .where("last > 0")
        .select("id", "key", F.posexplode(F.transform(F.sequence(F.lit(1), "last"), lambda i: F.slice("lines", i, WINDOW_LINES))).alias("at", "window"))
        .where(F.array_join("window", "").rlike(_WORD))
        .select("id", "key", (F.col("at") + 1).alias("at"), F.xxhash64("window").alias("h1"), F.xxhash64(F.lit(WINDOW_LINES), "window").alias("h2"))
    )
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "key", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    later = windows.join(first, ["h1", "h2"]).where(~F.struct("id", "key", "at").eqNullSafe(F.col("first")))
    return later.groupBy("id", "key").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove from `text` the lines under later occurrences of repeated three-line windows.

    The first occurrence by (doc_id, line number) stays whole.  Covered positions
    of a document are merged, so overlapping windows remove each line once.  Adds
    n_lines (0 for a null or empty text) and n_removed, replacing columns of these
    names; all rows and other columns stay, and texts of fewer than three lines stay as
    they are, repeated or not.  Rows with equal id and text get the
    same result, null ids come first in the order, a null text stays null, and a
    text that loses all its lines becomes ''.  An empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "n_removed")
    key, rid, starts, lines, kept = fresh(docs, "line_key", "line_id", "line_starts", "line_list", "line_kept")
    hits = repeated_windows(docs, doc_id, text).select(F.col("id").alias(rid), F.col("key").alias(key), F.col("starts").alias(starts))
    # the text crosses the join as its lines; below the join a lambda would split it again for each line
    rest = [F.col(c) for c in docs.columns if c != text]
    own = docs.select(*rest, F.split(text, "\n").alias(lines), F.xxhash64(doc_id, text).alias(key))
    joined = own.join(hits, (own[key] == hits[key]) & own[doc_id].eqNullSafe(hits[rid]), "left").drop(hits[key])
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (WINDOW_LINES - 1)))))
    n = F.size(lines)
    found = joined.withColumn(kept, F.when(F.col(starts).isNotNull(), F.array_except(F.sequence(F.lit(1), n), covered)))
    n_lines = F.when(F.col(lines).isNull() | ((n == 1) & (F.element_at(lines, 1) == "")), 0).otherwise(n)
    left = F.transform(kept, lambda i: F.element_at(F.col(lines), i))
    whole = F.array_join(F.coalesce(left, F.col(lines)), "\n")
    return found.select(
        *[whole.alias(c) if c == text else F.col(c) for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col(kept).isNull(), 0).otherwise(n - F.size(kept)).cast("long").alias("n_removed"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE regexp_matches(text, '[^\\x09-\\x0D\\x20]')
), w AS (
  SELECT doc_id, i, l[i : i + 2] AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) > 2)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn
  FROM w WHERE regexp_matches(array_to_string(g, ''), '[^\\x09-\\x0D\\x20]')
), c AS (
  SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1
), x AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM c)
), k AS (
  SELECT doc_id, count(*) - count(c.i) AS n_kept,
         coalesce(string_agg(line, chr(10) ORDER BY x.i) FILTER (WHERE c.i IS NULL), '') AS rest
  FROM x LEFT JOIN c USING (doc_id, i) GROUP BY doc_id
), n AS (
  SELECT doc_id, text, CASE WHEN length(text) > 0 THEN len(string_split(text, chr(10))) ELSE 0 END AS n_lines FROM documents
)
SELECT doc_id, n_lines, CASE WHEN n_kept IS NULL THEN 0 ELSE n_lines - n_kept END AS n_removed,
       CASE WHEN n_kept IS NULL THEN text ELSE rest END AS text
FROM n LEFT JOIN k USING (doc_id)
"""

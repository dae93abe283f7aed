"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are fitted: one of target text (labelled
rows of quality 1 that aren't toxic) and one of raw text (all labelled rows, which
stand for the corpus).  A document's log weight is the sum of log p_target / p_raw
over its n-grams, and k documents are drawn without replacement by Gumbel top-k at
temperature 1.  As the n-grams of a text are no independent draws, n of them count as
n * LENGTH / (n + LENGTH); without this length normalisation (LENGTH infinite) a few
telling words drown in a long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.jaccard import per_row
from tracelake.llm.kernels import _BYTE, _powers, blocks, mix, row_shingles, utf8, word_hashes, word_spans
from tracelake.llm.shared import stored

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
BYTE_GRAM = 5
SMOOTHING = 1.0
SIGMAS = 3
LENGTH = 500.0
TARGET_QUANTILE = 0.0005
FIT_TASKS = 12
LABELLED_ROWS = 50_000
BINS = 4096
_U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all rows end to end, and the row of each.

    N-grams are words, pairs of words (one n-gram for all pairs of equal words), and runs of five bytes within a word and the space before it.
    """
    starts, ends, rows = word_spans(data, offsets)
    n = np.diff(rows)
    words = word_hashes(data, starts, ends)
    own = np.repeat(np.arange(len(n)), n)
    next_same = own[1:] == own[:-1]
    pair = mix(np.where(words[:-1] == words[1:], _U(9), words[:-1] * _U(3) + words[1:]))[next_same]
    up, down = _powers(len(data) + BYTE_GRAM + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    length = ends - starts
    size = np.maximum(length - BYTE_GRAM + 2, 1)  # the first run is the space and four bytes
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    a = np.repeat(starts, size) + np.maximum(at - 1, 0)
    b = np.minimum(a + np.where(at > 0, BYTE_GRAM, BYTE_GRAM - 1), np.repeat(ends, size))
    run = mix((sums[b] - sums[a]) * down[a] + np.where(at > 0, _U(1 << 32), _U(1 << 33)))  # apart from the hashes of words
    hashed = np.concatenate([words, pair, run])
    return (hashed >> _U(64 - BUCKET_BITS)).astype(np.int64), np.concatenate([own, own[1:][next_same], np.repeat(own, size)])


def _counts(batches):
    """Batches of (text, target) to one pair of count vectors for a partition, as rows of its filled buckets."""
    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        chosen = np.asarray(batch.column("target")).astype(bool)
        for a, b in blocks(offsets):
            bucket, row = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[chosen[a:b][row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(target[at]), pa.array(raw[at])], ["bucket", "target", "raw"])


def ratio_vector(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target / p_raw of each bucket, 0 where the counts are within SIGMAS standard errors of equal models.

    A text has thousands of n-grams, so the noise of ratios without evidence would outweigh the few that tell.
    """
    share = target.sum() / max(raw.sum(), 1)
    expected = raw * share
    error = np.sqrt(expected * (1 - share))
    ratio = np.log((target + SMOOTHING) / (expected + SMOOTHING))
    return np.where((np.abs(target - expected) >= SIGMAS * error) & (raw > 0), ratio, 0.0)


def _least_shingles(batches):
    """Batches of (row_key, target, text) to (row_key, target, least): the MinHash of a text's shingles."""
    for batch in batches:
        least = np.zeros(batch.num_rows, np.uint64)
        for a, s, rows in row_shingles(batch.column("text")):
            least[a : a + len(rows) - 1] = per_row(s, rows, np.minimum)
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("target"), pa.array(least.view(np.int64))], ["row_key", "target", "least"])


def fit_ratio(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> tuple[np.ndarray, DataFrame]:
    """Fit both models on the labelled rows; where there are more than `most`, on those whose ids' hashes are in the lowest `most` / n.

    A row is target if no label of its id says otherwise.  Of labelled texts with the
    same MinHash, as copies have, one counts.  Returns the log ratio of each bucket, and
    (row_key, target) of the rows that were fitted, row_key being the hash of id and text.
    """
    known = labels.where("doc_id is not null and quality is not null")
    n = known.select(F.count_distinct("doc_id").alias("n")).first()["n"]
    below = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, most / max(n, 1)))
    chosen = known.where(below).groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")).alias("target"))
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    # both broadcasts hold about `most` rows of 12 bytes
    least = texts.join(F.broadcast(chosen), "doc_id").select("row_key", "target", "text").mapInArrow(_least_shingles, "row_key long, target int, least long")
    unlike = stored(least.groupBy("least").agg(F.min("row_key").alias("row_key"), F.min("target").alias("target")).select("row_key", "target"), "labelled")
    rows = texts.join(F.broadcast(unlike), "row_key").dropDuplicates(["row_key"]).select("text", "target").repartition(FIT_TASKS)
    counts = rows.mapInArrow(_counts, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in counts.toArrow().to_batches():  # BUCKETS rows at most
        at = np.asarray(batch.column("bucket"))
        target[at], raw[at] = np.asarray(batch.column("target")), np.asarray(batch.column("raw"))
    return ratio_vector(target, raw), unlike


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, row_key, log_weight, n_features) of documents; a text without words weighs 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            weight, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b in blocks(offsets):
                bucket, row = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                weight[a:b] = np.bincount(row, weights=shared.value[bucket], minlength=b - a)
                n[a:b] = np.bincount(row, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(weight * (LENGTH / (LENGTH + n))), pa.array(n)], ["doc_id", "row_key", "log_weight", "n_features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, log_weight double, n_features long")


def largest(frame: DataFrame, column: str, k: int) -> tuple[DataFrame | None, DataFrame, int]:
    """Rows that are surely among the k with the largest `column`, the rows that the border goes through, and how many of those belong.

    Found by histograms, without a global sort; the second frame has BINS rows at most, or one value.
    """
    ends = frame.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi, above = ends["lo"], ends["hi"], 0
    while True:
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            break
        inside = frame.where((F.col(column) >= lo) & (F.col(column) <= hi))
        bins = inside.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):  # BINS rows at most
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        if n <= BINS:
            break
    return frame.where(F.col(column) > hi), frame.where((F.col(column) >= lo) & (F.col(column) <= hi)), k - above


def gumbel_top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of (draw, row_key, row) with the largest `draw`, ties by `row`, a number that no two rows share."""
    n = scored.count()
    if k >= n:
        return scored
    if k <= 0:
        return scored.limit(0)
    sure, border, rest = largest(scored, "draw", k)
    if border.select("draw").distinct().limit(2).count() == 1:  # equal draws, any number of them
        more, border, rest = largest(border, "row", rest)
        sure = sure.unionByName(more)
    return sure.unionByName(border.orderBy(F.desc("draw"), F.desc("row")).limit(rest))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, most_labelled: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, row_key, log_weight, n_features, draw) of the documents drawn, k of them.

    k defaults to the number of documents whose weight reaches the TARGET_QUANTILE of
    the fitted target texts' weights.  The draw is the log weight plus Gumbel noise from
    a hash of the row, -log(-log((xxhash64('gumbel', row_key) mod 2^52 + 0.5) / 2^52)), so
    a run can be repeated.  Texts that are null or have no words weigh 0; repeated rows
    have equal draws and each counts, where only some of them fit which ones is open, as
    they are equal; null ids are drawn like others.  Without labelled rows all weights
    are 0 and all documents are drawn; no documents give no rows.
    """
    ratios, fitted = fit_ratio(docs, labels, most_labelled)
    uniform = (F.pmod(F.xxhash64(F.lit("gumbel"), "row_key"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = stored(log_weights(docs, ratios).withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform))).withColumn("row", F.monotonically_increasing_id()), "weights")
    if k is None:
        target = scored.join(F.broadcast(fitted.where("target = 1").select("row_key")), "row_key")  # about `most_labelled` keys
        low = target.agg(F.percentile_approx("log_weight", TARGET_QUANTILE, 100_000).alias("low")).first()["low"]
        k = scored.where(F.col("log_weight") >= (float("-inf") if low is None else low)).count()
    return gumbel_top_k(scored, k).drop("row")

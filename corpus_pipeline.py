"""From raw documents to token ids, in five stages that each work on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet
and read again for the next; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, jaccard, line_dedup, piece_codec, quality
from tracelake.llm.queries import table, tokenizer_file
from tracelake.llm.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rows(docs: DataFrame, found: DataFrame, name: str, how: str) -> DataFrame:
    """The rows of docs that are, or are not, among those found: told by id and the hash of id and text, so that unlike rows never meet by their hash alone."""
    keys = stored(found.select(F.col("doc_id").alias("key_id"), "row_key").distinct(), name)
    return docs.join(keys, (F.xxhash64("doc_id", "text") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("key_id")), how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the rest look unlike the labelled good texts.

    Rows are told apart by id and text: repeated rows stay or go together, so where only
    some of them were drawn, all stay.  Texts that are null or have no words weigh 0; null
    ids are drawn like others; without labels all documents stay.
    """
    return _rows(docs, quality.resample(docs, table(spark, sf_dir, "labels")), "drawn", "left_semi")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; a document that loses every word goes.

    Null texts and texts of fewer than three lines stay as they are; rows of equal id and
    text get the same result; null ids come first in the order of occurrences.
    """
    clean = line_dedup.dedup_lines(docs)
    left = clean.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, those without an id last.

    Rows are told apart by id and text: different texts of one id, or without an id,
    stay unless they are near copies.  Of rows equal in both, the first by its other
    columns stays.
    """
    found = stored(jaccard.jaccard_rows(docs).select("doc_id", "row_key", "component"), "near-copies")
    first = found.where("component is not null").groupBy("component").agg(F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first_key"))
    gone = found.join(first, "component").where("row_key <> first_key")
    left = _rows(docs, gone, "gone", "left_anti")
    repeated = found.groupBy("doc_id", "row_key").count().where("count > 1").limit(1).count()
    if not repeated:
        return left
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.to_json(F.struct(*rest)) if rest else F.lit(0))
    return left.groupBy("doc_id", F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("second"), "text")).agg(least.alias("row")).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to 0.8 or more; other texts of a leaking id stay.

    Null and empty texts contain nothing; a null id is like any other, and repeated rows
    stay or go together.
    """
    return _rows(docs, decontaminate.contaminated_rows(docs, table(spark, sf_dir, "benchmark")), "leaks", "left_anti")


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, one row for each row; a null text is encoded as an empty one."""
    return piece_codec.digests(docs, tokenizer_file("piece_bpe_32k.model"), "doc_id", "lang", "source")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: The classifier and the encoder have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

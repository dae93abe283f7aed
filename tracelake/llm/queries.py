"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import cap_filters, conversation_trie, decontaminate, jaccard, lattice_lm, line_dedup, piece_codec, quality, secrets, token_alignment, token_files, url_rules, warc
from tracelake.llm.shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; every executor has the package installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), "doc_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select("doc_id", "log_weight", "n_features", "draw", F.lit(True).alias("kept"))


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.cap_links(table(spark, sf_dir, "embeddings"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica in which one byte of each page whose id leaves 5 modulo 97 was damaged."""
    digests = stored(warc.warc_digests(table(spark, sf_dir, "pages"), F.col("page_id") % 97 == 5), "warc-digests")
    layout = ("page_id", "file", "place", "offset", "length")
    return warc.fixity(digests.select(*layout, "sha256"), digests.select(*layout, F.col("replica_sha256").alias("sha256")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_piece_codec, op2_line_dedup, op3_decontaminate, op4_lattice_lm, op5_importance_resampling, op6_cap_filters, op7_warc_fixity, op8_parity_join, op9_token_files, op10_url_rules, op11_token_alignment, op12_conversation_trie, op13_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op3_decontaminate": decontaminate.ORACLE, "op7_warc_fixity": warc.ORACLE}

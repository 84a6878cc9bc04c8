"""The queries of the training-data operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_rotation, oracles, warc
from .decontaminate import contamination
from .html_tree import main_text
from .huffman import token_files
from .near_dedup import near_duplicates
from .quality_fm import quality_scores
from .repetition import repetition_rules
from .sentencepiece_trie import encode_and_decode
from .substring_dedup import dedup_substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective, a row per turn."""
    return chat_rotation.rotate(_table(spark, sf_dir, "conversations"))


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdicts from suffix arrays, for every document."""
    ruled = repetition_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ruled.drop("text", "n_maximal_repeats", "longest_repeat", "covered_fraction")


def maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2's verdict rests on: maximal repeats of 8 words or more, for every document."""
    ruled = repetition_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ruled.select("doc_id", "n_maximal_repeats", "longest_repeat", "repeat_chars")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words found in every document, and the items whose rare words lie near each other there."""
    found = contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "n_near", F.sha2(F.array_join("near_ids", ","), 256).alias("near_sha256"),
    )


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response."""
    made = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a similarity of 0.8 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by a tree-structured model over its DOM."""
    return main_text(_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows removed from every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, k=20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document from a factorisation machine."""
    scored = quality_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to SentencePiece ids and decoded again."""
    import public_tokenizers

    return encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as Huffman-coded files and read back."""
    import public_tokenizers

    return token_files(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_rotation": op1_chat_rotation,
    "op2_suffix_repetition": op2_suffix_repetition,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_near_dedup": op5_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_huffman_tokens": op10_huffman_tokens,
    "maximal_repeats": maximal_repeats,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_rotation": chat_rotation.SQL,
    "op2_suffix_repetition": oracles.repetition(),
    "op3_decontaminate": oracles.CONTAMINATION,
    "op4_warc_derivatives": oracles.warc(),
    "op5_near_dedup": oracles.NEAR_DUPLICATES,
    "op6_html_extraction": oracles.MAIN_TEXT,
    "op7_substring_dedup": oracles.SUBSTRINGS,
}

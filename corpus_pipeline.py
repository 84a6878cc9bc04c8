"""The corpus pipeline: documents in, token ids of clean, distinct documents out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read by the next.  All stages but the last return the columns of
``docs``, whatever they are named, in their order; only ``doc_id`` and ``text`` are
needed, and ``n_chars``, where there is one, follows the text.

Defined cases, for every stage.  An empty table gives an empty one.  A null or empty
text is scored like any other, linked with nothing, has no windows, no benchmark words
and no ids.  A row with a null ``doc_id`` is judged by its text alone: near-duplicates
keep it.  Repeated rows are kept or dropped together; of equal texts with different ids
the smallest id stays.  Ties are decided by the smallest id, then the earliest place.
Texts of any length are processed whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.decontaminate import contamination
from quillon.llm.near_dedup import near_duplicates
from quillon.llm.quality_fm import quality_scores
from quillon.llm.sentencepiece_trie import encode_and_decode
from quillon.llm.substring_dedup import dedup_substrings
from quillon.storage import small_batches, stored


def _names(columns: list[str]) -> dict[str, str]:
    """Other names for all columns but the id and the text, so that none clashes with what an operator adds."""
    return {c: c if c in ("doc_id", "text") else f"given_{i}" for i, c in enumerate(columns)}


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names = _names(docs.columns)
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(n).alias(c) for c, n in names.items()))


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below 0.7 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, names = _apart(docs)
    return _back(quality_scores(docs, labels).where("predicted = 1"), names)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by a similarity of 0.8 or more on 5-word shingles, the smallest id stays."""
    gone = stored(near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier elsewhere go; a text without any stays as it is, an emptied one goes."""
    docs, names = _apart(docs)
    left = dedup_substrings(docs, k=20).where("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    if chars := names.get("n_chars"):
        left = left.withColumn(chars, F.when(cut, F.char_length("kept_text").cast(docs.schema[chars].dataType)).otherwise(F.col(chars)))
    return _back(left.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text"))), names)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a 10-word window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = stored(contamination(docs, benchmark, n=10, proximity=False).where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")).distinct(), "contaminated")
    docs, names = _apart(docs)
    same = docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs["text"]) == hit["hit_h"])
    return _back(docs.join(hit, same, "left_anti"), names)


@_stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again as a check."""
    import public_tokenizers

    return encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Near-duplicate components and the classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs

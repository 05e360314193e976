"""The training-data pipeline: quality rules, near-dedup, decontamination, PII, byte-level BPE.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skriva.llm import bpe, decontaminate, neardup, pii, quality
from skriva.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans are cut out; documents that are mostly benchmark text go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (similarity 0.8 or more) stays."""
    return neardup.keep_first(docs, Scratch(spark, "neardup"), neardup.STAGE_PERCENT)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to format-preserving pseudonyms; texts keep their lengths."""
    return pii.pseudonymise(docs, pii.SAMPLE_KEY)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: The pipeline pseudonymises and tokenises, which SQL cannot express; tests/llm compares it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

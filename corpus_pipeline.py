"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, tokenisation.

Every stage takes all documents that its predecessor kept, is written to the shared folder and read again.
All but the last return the columns that the documents have. Nulls, empty texts, repeated rows and empty
tables are handled as the operators' modules say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, lines, minhash, pieces, quality
from vellum.llm.common import settle, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that match an earlier one; a document with no line left goes."""
    return lines.drop_lines(docs, docs.columns, counted="n_chars" if "n_chars" in docs.columns else None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8)."""
    return minhash.keep_first(docs, docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), docs.columns)


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and the text decoded from them."""
    import public_tokenizers

    encoded = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.selectExpr("doc_id", "n_tokens", "ids", "cast(decoded AS string) AS decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokenisation", tokenisation),
]

#: A learned list, hash bands, lookbehind patterns and a tokenizer are beyond SQL; tests/llm/test_pipeline.py
#: holds every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), folder, name)
    return docs

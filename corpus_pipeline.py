"""A training corpus in five stages: rules, near duplicates, secrets, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before it kept, and is
written and read back before the next. All but the last return the columns of ``documents``.

Cases: an empty table gives no rows at each stage. A null text has no words and goes with the rules. Rows with one
``doc_id`` and text, null ids included, are one document to the second stage, which keeps one. Columns beside those of
``documents`` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import bpe, jaccard, mixing, quality, secrets
from termloom.llm.common import small_batches, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    small_batches(spark)
    return quality.kept_rows(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mask; the documents stay."""
    small_batches(spark)
    return secrets.masked(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    small_batches(spark)
    return mixing.mixture(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (decimal, joined by blanks), n_tokens, and round_trip: 1 if the ids decode to the text."""
    small_batches(spark)
    return bpe.encoded(docs, bpe.default_ranks())


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", duplicates_stage),
    ("secret_scan", secrets_stage),
    ("mixture", mixture_stage),
    ("byte_bpe", tokens_stage),
]
# The stages draw on hashes and vocabularies that SQL lacks; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

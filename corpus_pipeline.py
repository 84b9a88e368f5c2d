"""Corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of ``docs``; the
last returns the pieces of the packed sequences. Stages write their tables in the shared folder of the session.

In every stage null and repeated ids stay rows of their own, extra columns pass through whatever their names, and an empty
table gives an empty one of the same columns. A null text has no words: the quality rules reject it, as they do any text of
fewer than 20 words; a stage that is given one all the same keeps it (near duplicates, secrets), takes it no times (mixture)
or packs its end token alone (packing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acadspark.llm.common import staged, table
from acadspark.llm.mixing import mixed_documents
from acadspark.llm.ngrams import unique_documents
from acadspark.llm.packing import pack_report
from acadspark.llm.rules import cleaned_documents
from acadspark.llm.secrets import redacted_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the rules."""
    return cleaned_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return unique_documents(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return redacted_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their source take them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, one a sequence."""
    return pack_report(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: Tokenization and the character models have no SQL; tests/llm/test_pipeline.py checks each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

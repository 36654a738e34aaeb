"""The corpus pipeline: quality rules, one document of each near-duplicate group, decontamination, PII, byte-level BPE.

Edge cases: a null or empty text has too few words and goes in the first stage, so later stages see none from it, though each
of them takes them by itself (kept by the second and third, unchanged by the fourth, no ids in the last); a row without an id is
a document like others, and of its near duplicates one with an id stays first; of rows that are equal in id and text the second
stage keeps one, and of equal ids with different texts both; null lang and source are groups of their own; ties go to the
smallest id; an empty table gives an empty result with the columns of its stage; further columns pass through all but the last
stage, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import byte_bpe, decontaminate, neardup, pii, quality
from ridgeline.llm.scratch import written
from ridgeline.llm.tables import table

#: Byte-level BPE is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the robust outlier test accept."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id: shingles of five words, similarity 0.8."""
    return neardup.one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for their entities."""
    return pii.replaced(docs, pii.secret_key(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text and the digest of the bytes decoded from them."""
    return byte_bpe.digests(docs, *byte_bpe.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("byte_level_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

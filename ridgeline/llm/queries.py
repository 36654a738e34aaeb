"""The queries of this subpackage, by the names under which ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op10
from .decontaminate import contamination
from .language import identified
from .neardup import near_duplicates
from .oracles import ORACLES
from .pii import replaced, secret_key
from .quality import quality_verdicts
from .ranking import ranked
from .repeats import repeats
from .tables import table
from .token_files import round_trip
from .toxicity import toxicity
from .urls import judged
from .variants import spelling_variants
from .vectors import near_vectors

__all__ = ["ORACLES", "QUERIES"]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark windows that occur in every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return identified(table(spark, sf_dir, "documents"))


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's token ids, read back from the files."""
    return round_trip(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judged(table(spark, sf_dir, "pages"), "page_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for its entities, and how many there were."""
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark), counts=True)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of every document that repeat across documents."""
    return repeats(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_verdicts(table(spark, sf_dir, "documents"), "doc_id")


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the bytes decoded from them."""
    return op10(spark, table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its accepted form."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_token_id_files": op4_token_id_files,
    "op5_url_filters": op5_url_filters,
    "op6_toxicity": op6_toxicity,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_level_bpe": op10_byte_level_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

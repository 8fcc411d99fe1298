"""The operators applied to the corpus tables, one query each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bitslices import ORACLE as NEGATIVES_SQL
from .bitslices import hard_negatives
from .common import table
from .decontam import overlaps
from .packing import pack_documents
from .quality import ORACLE as STATISTICS_SQL
from .quality import judge, text_statistics
from .sharding import kd_tree_shards
from .simhash import near_duplicates
from .spfp import pack_by_histogram
from .substring import ORACLE as SUBSTRING_SQL
from .substring import remove_repeats
from .tokenbin import token_archive
from .tokencount import count_tokens
from .toxicity import score_toxicity
from .treaps import ORACLE as SEARCH_SQL
from .treaps import ranked_search
from .warc import ORACLE as WARC_SQL
from .warc import archive_pages


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=4096)


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of op4 go by, without what is learned, so that SQL can follow."""
    return text_statistics(table(spark, sf_dir, "documents"))


def op5_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_tree_shards(table(spark, sf_dir, "documents"), shards=8)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_archive(table(spark, sf_dir, "documents"), end_id=0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), limit=2048)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), distance=2, shingle=3, seed=42)


def op11_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_histogram(table(spark, sf_dir, "documents"), capacity=2048)


def op12_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity,
        op2_best_fit_packing,
        op3_warc_archive,
        op4_quality_rules,
        op5_kd_tree_sharding,
        op6_token_binary,
        op7_token_counts,
        op8_benchmark_decontamination,
        op9_substring_dedup,
        op10_simhash_near_dedup,
        op11_shortest_pack_first,
        op12_inverted_treaps,
        op13_bit_sliced_negatives,
        quality_statistics,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_warc_archive": WARC_SQL, "op9_substring_dedup": SUBSTRING_SQL, "op12_inverted_treaps": SEARCH_SQL, "op13_bit_sliced_negatives": NEGATIVES_SQL, "quality_statistics": STATISTICS_SQL}

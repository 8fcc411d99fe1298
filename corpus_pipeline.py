"""From raw documents to packed sequences, in five stages.

Each stage takes what its predecessor kept and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import remove, result, scratch, table
from millrace.llm.decontam import keep_clean
from millrace.llm.jaccard import keep_one_near
from millrace.llm.packing import pack_documents
from millrace.llm.quality import keep_good
from millrace.llm.substring import without_repeats

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 and more) the document of least doc_id stays.

    SimHash fingerprints link them first, checked by Jaccard; the pairs whose fingerprints are too far apart go by an exact prefix filter.
    """
    return keep_one_near(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that occur earlier go from the texts, and n_chars follows."""
    return without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and its place there."""
    return pack_documents(docs, capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules, fingerprints, tiles and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one row a packed piece.

    Every stage's result is written once, so that no stage runs again when its successor reads it several times, and is
    removed once the successor's is written. Nulls, empty texts and repeated rows are as the stages say: null and empty
    texts fail the base quality rules and go, one of the rows that repeat doc_id and text stays, and an empty table gives no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        paths: list[str] = []
        with scratch(spark):
            docs = result(stage(spark, docs, sf_dir), name, paths)
        remove(spark, before)
        before = paths
    return docs

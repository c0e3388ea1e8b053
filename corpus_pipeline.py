"""The corpus pipeline: documents in, packed training sequences out, stage by stage.

Stages take and return all columns of their documents, except the last, which returns pieces of sequences. Nulls, empty
texts, repeated rows and empty tables are handled as the operators' docstrings say: a null text is scored as an empty
one and keeps being null where a stage does not rewrite it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowfind.llm.common import table
from stowfind.llm.decontamination import decontaminated
from stowfind.llm.lines import line_dedup
from stowfind.llm.near_copies import near_duplicates_dropped
from stowfind.llm.packing import pack_documents
from stowfind.llm.quality import quality_kept
from stowfind.session import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_kept(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose chunks of lines that an earlier document has; their lengths follow, where there is such a column."""
    kept = line_dedup(docs)
    if "n_chars" in docs.columns:
        shorter = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("__n_removed_chunks") > 0, shorter).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return near_duplicates_dropped(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their places in sequences of 1024."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Fingerprints, scores and merges have no SQL counterpart; the tests of each stage's operator hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

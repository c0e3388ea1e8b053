"""The registered queries of the training-text operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowfind.llm import variants
from stowfind.llm.alignment import cross_alignment
from stowfind.llm.common import table
from stowfind.llm.decontamination import contaminated
from stowfind.llm.embeddings import vector_links
from stowfind.llm.languages import languages
from stowfind.llm.licenses import license_scan
from stowfind.llm.lines import line_dedup
from stowfind.llm.packing import pack_documents
from stowfind.llm.quality import quality_scores
from stowfind.llm.simhash import simhash_components
from stowfind.llm.substrings import repeats_removed
from stowfind.llm.tokens import token_counts
from stowfind.llm.urls import url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(table(spark, folder, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    placed = simhash_components(table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return placed.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents")).drop("places")


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(table(spark, folder, "pages"))


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_embedding_links(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links(table(spark, folder, "embeddings"))


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"),
                       F.col("__n_removed_lines").alias("n_removed_lines"),
                       F.col("__n_removed_chunks").alias("n_removed_chunks"), "text")


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = repeats_removed(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


ORACLE["op12_spelling_variants"] = variants.SQL


@query
def op13_cross_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return cross_alignment(table(spark, folder, "documents"))

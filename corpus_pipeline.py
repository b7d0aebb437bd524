"""A corpus pipeline over documents: quality rules, near-duplicates, benchmark passages, secrets, mixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontam, mixing, near_dup, quality, secrets
from cadenza.llm.store import keep, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or repeat themselves too much go.

    Null, empty and short texts go; repeated rows go or stay alike; an empty table stays
    empty. Whole texts count, however long.
    """
    return quality.kept_documents(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id; rows without an id come last.

    Of rows that repeat id and text one stays; rows of one id but other texts are judged by
    their texts. Texts without words form no groups and stay. An empty table stays empty.
    """
    return near_dup.distinct_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go.

    Null and very short texts stay, as does all where there are no items; repeated rows go
    or stay alike; all windows of long texts count.
    """
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and n_chars made anew; no document goes, null and empty texts stay as they are, repeated rows alike."""
    return secrets.without_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a row for each copy, counted by copy.

    Null sources are a source of their own, null ids hash as empty ones, repeated rows get
    as many copies each; an empty table stays empty.
    """
    copy = "copy" if "copy" not in docs.columns else "mix_copy"
    return mixing.mix(docs).withColumnRenamed("copy", copy).select("row.*", copy)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
]

#: SQL has no MinHash sketches, SimHash windows or rolling hashes; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), folder)
    return docs

"""The registered queries of this package, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.llm import (
    centroids,
    collocations,
    decontam,
    licenses,
    lines,
    lm,
    mixing,
    neardup,
    passages,
    quality,
    sharding,
    urls,
    vectordedup,
)
from tarnsearch.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 40


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.shared_passages(_table(spark, folder, "documents"))


def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm.backoff_scores(_table(spark, folder, "documents"))
    return scored.select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"))


# Host, path and action of the rules.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.filter_urls(_table(spark, folder, "pages"), rules)


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_common_lines(_table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).drop("source")


def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), neardup.NearDup(shingle=3, percent=85))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(_table(spark, folder, "documents"), SHARDS).select(
        F.col("_row.doc_id").cast("bigint").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectordedup.near_duplicate_vectors(_table(spark, folder, "embeddings"))


def centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.centroid_clusters(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination,
    "op2_substring_dedup": substring_dedup,
    "op3_lm_scores": lm_scores,
    "op4_license_scan": license_scan,
    "op5_url_filter": url_filter,
    "op6_quality_rules": quality_rules,
    "op7_line_dedup": line_dedup,
    "op8_mix_sources": mix_sources,
    "op9_near_dedup": near_dedup,
    "op10_shards": shards,
    "op11_collocations": phrase_collocations,
    "op12_vector_dedup": vector_dedup,
    "op13_centroid_clusters": centroid_clusters,
}

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.operators.embedding import hash_embedder
from tarnsearch.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIM = 256
EMBEDDER = hash_embedder(DIM)


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle where SQL can say the same."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# What tells the rows of a table apart.
KEYS = {
    "documents": "doc_id",
    "benchmark": "item_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "conversations": "conv_id",
    "labels": "doc_id",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", KEYS[name])


def path_of_document():
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the pipeline takes them: doc_id, source_path, text."""
    return table(spark, folder, "documents").select(
        "doc_id", path_of_document().alias("source_path"), "text"
    )


def as_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document standing for one chunk."""
    return documents(spark, folder).withColumnRenamed("doc_id", "chunk_id")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", "label"
    )

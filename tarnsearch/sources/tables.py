"""Chunks, vectors and manifests on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_LINE = "page_content STRING, metadata MAP<STRING, STRING>"
MANIFEST = "path STRING, size BIGINT, modified TIMESTAMP, sha256 STRING"


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A Parquet table. With fewer files than cores its rows are dealt out over them by
    ``key``: a file of one row group is otherwise one task, however many cores wait."""
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores, key) if len(table.inputFiles()) < cores else table


def write_chunks(chunks: DataFrame, path: str, text_col: str = "text") -> None:
    """JSON lines ``{page_content, metadata}``; every other column is metadata."""
    metadata = [c for c in chunks.columns if c != text_col]
    chunks.select(
        F.col(text_col).alias("page_content"), F.struct(*metadata).alias("metadata")
    ).write.json(path)


def read_chunks(spark: SparkSession, path: str, metadata: Sequence[str] = ()) -> DataFrame:
    """Chunks back from JSON lines. File order means nothing: sort by ``chunk_id``."""
    lines = spark.read.schema(CHUNK_LINE).json(path)
    return lines.select(
        F.col("metadata")["chunk_id"].cast("bigint").alias("chunk_id"),
        *(F.col("metadata")[name].alias(name) for name in metadata),
        F.col("page_content").alias("text"),
    )


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select(
        F.col("chunk_id").cast("bigint"), F.col("embedding").cast("array<float>")
    ).write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id BIGINT, embedding ARRAY<FLOAT>").parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    known = T.StructType.fromDDL(MANIFEST)
    manifest.select(
        *(
            F.col(f.name).cast(f.dataType)
            if f.name in manifest.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in known
        )
    ).write.parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The saved snapshot; an empty one when none was saved, so every file is new."""
    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)

"""Vectors kept by what was embedded: a text that was seen before never reaches the model again.

A vector belongs to the SHA-256 of its text and to the model's name. Chunks that are equal, that moved, or come
back under another id share it; only digests the store lacks are embedded, each once, and added.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.operators.embedding import Embedder, embed

STORED = "digest STRING, embedding ARRAY<FLOAT>"


def text_digest(text: str | Column = "text") -> Column:
    """A null text counts as an empty one, as it does for the model."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256)


def _folder(root: str, embedder: Embedder) -> str:
    kind = "unit" if embedder.normalize else "raw"
    safe = "".join(c if c.isalnum() or c in "-_." else f"%{ord(c):x}" for c in embedder.name)
    return f"{root}/{safe}-{embedder.dim}-{kind}"


def stored_vectors(spark: SparkSession, root: str, embedder: Embedder) -> DataFrame:
    """``(digest, embedding)`` of one model; empty where nothing was stored. A digest is there once or, after two
    writers at a time, with equal vectors."""
    try:
        found = spark.read.schema(STORED).option("recursiveFileLookup", True).parquet(_folder(root, embedder))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)
    return found


def add_missing(texts: DataFrame, root: str, embedder: Embedder, text_col: str = "text") -> None:
    """Embed the texts whose digests the store lacks, one of each, and write them to a folder of their own."""
    spark = texts.sparkSession
    known = stored_vectors(spark, root, embedder).select("digest")
    # Equal texts are one row before the shuffle and after it.
    lacking = (
        texts.select(text_digest(text_col).alias("digest"), F.coalesce(text_col, F.lit("")).alias("text"))
        .join(known, "digest", "left_anti")
        .dropDuplicates(["digest"])
    )
    embed(lacking, embedder, id_col="digest").write.parquet(f"{_folder(root, embedder)}/{uuid.uuid4().hex}")


def embed_stored(texts: DataFrame, root: str, embedder: Embedder, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, embedding)`` of all texts, by way of the store below ``root``."""
    add_missing(texts, root, embedder, text_col)
    vectors = stored_vectors(texts.sparkSession, root, embedder).dropDuplicates(["digest"])
    return texts.select(id_col, text_digest(text_col).alias("digest")).join(vectors, "digest").select(id_col, "embedding")

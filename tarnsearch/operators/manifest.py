"""Fingerprints of sources and what changed between two of them."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.sources.folder import read_folder


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``, empty ones too: relative path, size, modification time, SHA-256.

    A file that cannot be read has a null digest, so it counts as changed once it can. Files are hashed
    piece by piece where they are listed; none is held whole.
    """
    if not urlparse(root).path.startswith("/"):
        raise ValueError(f"root must be an absolute path, got {root!r}")
    return read_folder(spark, root).select("path", "size", "modified", "sha256")


def content_manifest(documents: DataFrame, path: Column, text_col: str = "text") -> DataFrame:
    """The same for documents in a table; size in bytes."""
    return documents.select(
        path.alias("path"),
        F.octet_length(text_col).cast("bigint").alias("size"),
        F.sha2(F.encode(F.col(text_col), "utf-8"), 256).alias("sha256"),
    )


def added(saved: DataFrame, current: DataFrame) -> DataFrame:
    return current.join(saved.select("path"), "path", "left_anti")


def removed(saved: DataFrame, current: DataFrame) -> DataFrame:
    return saved.join(current.select("path"), "path", "left_anti")


def _differs(left: str, right: str, compare_mtime: bool) -> Column:
    compared = ["size", "sha256"] + (["modified"] if compare_mtime else [])
    same = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in compared]
    differs = F.lit(False)
    for equal in same:
        differs = differs | ~equal
    return differs


def changed(saved: DataFrame, current: DataFrame, compare_mtime: bool = False) -> DataFrame:
    """Current rows of paths known before with another content."""
    pairs = saved.alias("s").join(current.alias("c"), F.col("s.path") == F.col("c.path"))
    return pairs.filter(_differs("s", "c", compare_mtime)).select("c.*")


def diff_files(saved: DataFrame, current: DataFrame, compare_mtime: bool = False) -> DataFrame:
    """``(path, status)`` of every path that is new, removed or changed: one full join."""
    joined = saved.alias("s").join(
        current.alias("c"), F.col("s.path") == F.col("c.path"), "full_outer"
    )
    status = (
        F.when(F.col("s.path").isNull(), "new")
        .when(F.col("c.path").isNull(), "removed")
        .when(_differs("s", "c", compare_mtime), "changed")
    )
    return joined.select(
        F.coalesce("s.path", "c.path").alias("path"), status.alias("status")
    ).filter("status IS NOT NULL")


def reasons(diff: DataFrame) -> DataFrame:
    """What changed, in words: a row ``new source file: a`` per path, with the number of
    files of that status. No row and no task gathers a list of paths."""
    # At most three rows.
    counts = diff.groupBy("status").agg(F.count("*").alias("n_files"))
    return diff.join(F.broadcast(counts), "status").select(
        "status",
        "path",
        "n_files",
        F.concat("status", F.lit(" source file: "), F.col("path")).alias("reason"),
    )

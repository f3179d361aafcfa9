"""A manifest under a tree of digests, so that comparing two of them looks only where they differ.

Paths fall into buckets by a hash. A bucket's digest is the exclusive-or of its rows' hashes (with
their number), so it needs no order and is combined before the shuffle; a node's is that of its children. Two trees are
compared from the root: below equal nodes nothing is read. What is left is the list of buckets that differ, at most
``BUCKETS`` numbers; only their rows are joined, and of a stored manifest only their folders are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.operators.manifest import diff_files
from tarnsearch.params import positive

BUCKETS = 4096
FAN_OUT = 16
NODE = "level INT, node INT, digest BIGINT, check BIGINT, n BIGINT, buckets INT"
ENTRY = "path STRING, size BIGINT, sha256 STRING, bucket INT"


def bucket_of(path: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def levels(buckets: int) -> int:
    """Levels below the root."""
    depth, width = 0, 1
    while width < buckets:
        depth, width = depth + 1, width * FAN_OUT
    return depth


def digest_tree(manifest: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(level, node, digest, check, n, buckets)``: level 0 is the root, the deepest has a node per bucket that is not empty."""
    row = [F.col("path"), F.col("size"), F.col("sha256")]
    leaves = manifest.groupBy(bucket_of("path", buckets).alias("node")).agg(
        F.bit_xor(F.xxhash64(*row)).alias("digest"), F.bit_xor(F.xxhash64(F.lit(1), *row)).alias("check"), F.count("*").alias("n")
    )
    depth = levels(positive("buckets", buckets))
    # At most a row per bucket and level from here on.
    above = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    spread = leaves.select(above, "node", "digest", "check", "n")
    width = F.pow(F.lit(FAN_OUT), F.lit(depth) - F.col("level"))
    return spread.groupBy("level", F.floor(F.col("node") / width).cast("int").alias("node")).agg(
        F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"), F.sum("n").alias("n"), F.lit(buckets).alias("buckets")
    )


def differing_buckets(saved: DataFrame, current: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Buckets whose rows differ between two trees, found level by level from the root."""
    open_nodes, depth = [0], levels(buckets)
    for level in range(depth + 1):
        if not open_nodes:
            break
        # The children of nodes that differ: at most FAN_OUT times as many.
        here = F.col("level") == level
        one, two = (t.where(here & F.col("node").isin(open_nodes)).drop("level", "buckets") for t in (saved, current))
        both = one.alias("a").join(two.alias("b"), "node", "full_outer")
        same = F.lit(True)
        for c in ("digest", "check", "n"):
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        differ = [r.node for r in both.where(~same).select("node").collect()]
        open_nodes = differ if level == depth else [n * FAN_OUT + i for n in differ for i in range(FAN_OUT)]
    return sorted(open_nodes)


@dataclass(frozen=True)
class StoredManifest:
    """A manifest on disk, a folder per bucket, with its tree."""

    entries: DataFrame
    tree: DataFrame
    buckets: int


def write_tree(manifest: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store ``(path, size, sha256)`` by bucket, and the tree beside it."""
    entries = manifest.select("path", "size", "sha256", bucket_of("path", buckets).alias("bucket"))
    entries.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/entries")
    digest_tree(manifest, buckets).coalesce(1).write.parquet(f"{path}/tree")


def open_tree(spark: SparkSession, path: str) -> StoredManifest:
    tree = spark.read.schema(NODE).parquet(f"{path}/tree")
    root = tree.first()
    return StoredManifest(spark.read.schema(ENTRY).parquet(f"{path}/entries"), tree, root.buckets if root else BUCKETS)


def diff(saved: StoredManifest, current: DataFrame) -> DataFrame:
    """What ``manifest.diff_files`` says of the stored manifest and the current one, joining only buckets that differ.

    ``current`` is read twice, once for its tree: keep it written if it is costly to make.
    """
    differ = differing_buckets(saved.tree, digest_tree(current, saved.buckets), saved.buckets)
    before = saved.entries.where(F.col("bucket").isin(differ)).drop("bucket")
    now = current.select("path", "size", "sha256").where(bucket_of("path", saved.buckets).isin(differ))
    return diff_files(before, now)

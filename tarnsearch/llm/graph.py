"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.plans.work import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of every node on its smallest neighbour; edges are (u, v) with u > v."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if small:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        joined.where("v < u").where("m = v").select("u", "v")
    ).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    up = edges.groupBy("u").agg(F.count("*").alias("n"))
    inner = edges.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1))
    return not up.union(inner).groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").head(1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component``: the smallest node reachable, for every node with a link.

    Alternating large and small stars: the number of rounds grows with the logarithm of the
    longest path. A node's neighbours are never gathered: minima are combined before the shuffle,
    and the join back may be split. Each round is written to the shared folder.
    """
    edges = materialize(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v"))
        .distinct(),
        "edges",
    )
    while not _stars_only(edges):
        edges = materialize(_star(_star(edges, small=False), small=True), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

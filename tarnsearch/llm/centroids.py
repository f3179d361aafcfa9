"""Centroid clustering over zone maps, in whole numbers throughout.

1. Components become integers; vectors are ordered along a Hilbert curve and cut, in that order,
   into blocks of ``BLOCK`` vectors, each with the least and greatest value per component (its box).
   The blocks are written once.
2. In a round every task compares its blocks with the centroids. A centroid is a block's candidate only
   if the least distance from it to the box is not above the smallest of the greatest distances
   from any centroid to the box. Vectors are compared exactly with candidates only.
3. A task returns a sum and a count per centroid; Spark adds them. Centroids, k vectors, are what
   the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.plans.work import materialize

BLOCK = 256
LARGEST = 1 << 27  # integers are cut to this, so that squared distances of 64 components fit 63 bits
EXACT = 1 << 53


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids, which start as the vectors whose ids hash lowest with ``seed``, after ``rounds``
    rounds; a component x counts as floor(``scale`` * x). ``bits`` per component of the curve."""

    k: int = 16
    rounds: int = 3
    width: int = 64
    scale: int = 64
    seed: str = "1"
    bits: int = 4


def hilbert_keys(values: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of rows of numbers below 2**bits, as rows of bytes, highest first.

    Coordinates are turned in place, component by component, from the highest bit down (so that
    every subcube is entered where the one before was left), then Gray-coded; the bits are read across components.
    """
    x = values.T.astype(np.uint32).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for axis in x:
            turned = (axis & np.uint32(q)) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap).astype(np.uint32)
            axis ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0)).astype(np.uint32)
        q >>= 1
    x ^= flip
    read = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])
    return np.packbits(read.reshape(bits * len(x), -1).T.astype(np.uint8), axis=1)


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ordered(how: Clustering, most: float):
    """Integers and curve keys. ``most`` is the greatest component; it only scales the curve."""
    side = 1 << how.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = whole_numbers(_matrix(batch.column("vec"), how.width), how.scale)
            reach = max(1.0, min(most * how.scale + 1, LARGEST))
            cells = np.clip((numbers + reach) * (side / (2 * reach)), 0, side - 1).astype(np.int64)
            keys = hilbert_keys(cells, how.bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([k.tobytes() for k in keys], pa.binary()), _lists(numbers.astype(np.int32))],
                ["id", "key", "vec"],
            )

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


BLOCKS = "block bigint, id bigint, vec array<int>, lo array<int>, hi array<int>"


def _blocks(how: Clustering):
    """Neighbours on the curve as blocks. The first vector of a block carries its box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = _matrix(batch.column("vec"), how.width)
            block = number + np.arange(len(rows)) // BLOCK
            heads = np.arange(0, len(rows), BLOCK)
            offsets = np.cumsum(np.arange(len(rows) + 1) % BLOCK == 1, dtype=np.int32) * how.width
            none = pa.array(np.arange(len(rows)) % BLOCK != 0)
            boxes = (
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(side.reduceat(rows, heads).ravel()), mask=none)
                for side in ((np.minimum, np.maximum) if len(rows) else ())
            )
            if len(rows):
                number += len(heads)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), batch.column("id"), batch.column("vec"), *boxes], ["block", "id", "vec", "lo", "hi"]
                )

    return run


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector inside the box, ties included."""
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    outside = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    farthest = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    return np.flatnonzero((outside**2).sum(axis=1) <= (farthest**2).sum(axis=1).min())


def nearest(rows: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the nearest of some centroids (ties: the smaller number) and its squared distance."""
    some = centroids[among]
    most = int(max(np.abs(rows).max(initial=0), np.abs(some).max(initial=0)))
    if 4 * most * most * rows.shape[1] < EXACT:  # whole numbers that a double holds
        a, b = rows.astype(np.float64), some.astype(np.float64)
        distances = ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    else:
        rows = rows.astype(np.int64)
        distances = np.stack([((rows - c) ** 2).sum(axis=1) for c in some], axis=1)
    best = distances.argmin(axis=1)
    return among[best], distances[np.arange(len(rows)), best]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """Runs of a block's vectors: ids, vectors, clusters, distances. The box is that of the whole
    block, or, where a split of the file begins inside a block, that of the part read here."""
    width = centroids.shape[1]
    known, among = None, None
    for batch in batches:
        ids, rows = batch.column("id"), _matrix(batch.column("vec"), width)
        block = batch.column("block").to_numpy()
        head = batch.column("lo").is_valid().to_numpy(zero_copy_only=False)
        lo, hi = (_matrix(batch.column(c), width) for c in ("lo", "hi"))
        box = np.cumsum(head) - 1
        cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(block)] if len(block) else []):
            part = rows[a:b]
            if head[a]:
                among = candidates(lo[box[a]], hi[box[a]], centroids)
            elif block[a] != known:
                among = candidates(part.min(axis=0), part.max(axis=0), centroids)
            known = block[b - 1] if head[a] or block[a] == known else None
            yield ids.slice(a, b - a), part, *nearest(part, centroids, among)


def _sums(centroids: np.ndarray):
    """Per task and centroid the number of its vectors and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)
        chosen = np.eye(len(centroids))
        for _, rows, cluster, _ in _assigned(batches, centroids):
            n += np.bincount(cluster, minlength=len(n))
            total += (chosen[cluster].T @ rows.astype(np.float64)).astype(np.int64)  # below 2**53: exact
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), _lists(total[some])], ["cluster", "n", "sums"])

    return run


def _nearest(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def curve_blocks(table: DataFrame, how: Clustering, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Vectors of ``width`` finite components in curve order, as integers: block, id, vec, and lo and hi where a block begins."""
    kept = _kept(table, how, vector, key)
    # The greatest component is one number.
    most = kept.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 0.0
    keyed = kept.select("id", "vec").mapInArrow(_ordered(how, float(most)), "id bigint, key binary, vec array<int>")
    # The hash splits vectors that share a place on the curve between partitions.
    ranged = keyed.withColumn("h", F.xxhash64("id")).repartitionByRange("key", "h").sortWithinPartitions("key", "h", "id")
    return ranged.select("id", "vec").mapInArrow(_blocks(how), BLOCKS)


def _kept(table: DataFrame, how: Clustering, vector: str, key: str) -> DataFrame:
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        table.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
        .where(F.size("vec") == how.width)
        .where(finite)
    )


def first_centroids(table: DataFrame, how: Clustering, vector: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """The k vectors whose id hashes lowest, lowest first."""
    name = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = _kept(table, how, vector, key).select(name.alias("name"), "vec").orderBy("name", "vec").limit(how.k).collect()
    return whole_numbers(np.array([r.vec for r in drawn]).reshape(-1, how.width), how.scale)


def centroid_clusters(
    table: DataFrame, how: Clustering | None = None, vector: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another width, or hold a null or non-finite component are left out.
    With fewer vectors than k there are as many centroids. Rows that repeat an id are vectors of their own; of
    such that hash alike the smaller vector comes first. A null id hashes as an empty one.
    An empty table gives no rows; other columns are not looked at. Components beyond 2**27 / scale
    in size count as that.
    """
    how = how or Clustering()
    centroids = first_centroids(table, how, vector, key)
    blocks = materialize(curve_blocks(table, how, vector, key), "blocks")
    for _ in range(how.rounds if len(centroids) else 0):
        parts = blocks.mapInArrow(_sums(centroids), "cluster bigint, n bigint, sums array<bigint>")
        cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
        summed = cells.groupBy("cluster", "at").agg(
            F.sum(F.col("x").cast("decimal(28,0)")).alias("x"), F.sum("n").alias("n")
        )
        for r in summed.collect():  # k times width rows
            centroids[r.cluster, r["at"]] = int(r.x) // r.n
    near = materialize(blocks.mapInArrow(_nearest(centroids), "id bigint, cluster int, distance bigint"), "nearest")
    # At most k rows.
    inertia = {r.cluster: r.inertia for r in near.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    clusters = table.sparkSession.createDataFrame(
        [(c, n, sum(inertia.values()), names[c]) for c, n in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return near.join(F.broadcast(clusters), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

"""Vector search over an inverted file: vectors stored by cell, cells chosen by their centres.

A coarse quantiser cuts the vectors into cells. They are written with one folder per cell, so a
question reads only the folders of the cells it probes; there it is compared with every
vector, in double precision. ``topk`` probes a fixed number of cells and may miss hits; ``calibrate``
finds the number that a wanted recall takes. ``exact_topk`` goes on from there: no vector of a
cell can score above ``q . centre + |q| radius``, so cells below the k-th score found so far hold
nothing better, and the others are read too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.functions.topk import RunningTopK, round_half_up
from tarnsearch.functions.vectors import unit_rows
from tarnsearch.operators.dense import HITS, question_slices, vector_matrix
from tarnsearch.operators.merge import merge_best
from tarnsearch.params import BROADCAST_VECTOR_BYTES, K_DENSE, SCORE_DIGITS, check_metric, positive

# Centres are found in whole multiples of this, so that the order of additions changes nothing.
GRAIN = 2.0**-20
ROWS_PER_FILE = 1 << 20
CENTRES_BYTES = 64 << 20
TRAIN_PER_CELL = 256  # vectors of the bounded sample that centres are fitted on


@dataclass(frozen=True)
class InvertedFile:
    """A stored inverted file. ``centres`` has a row per cell; ``radius`` is its farthest vector's distance.
    The folders of ``vectors`` are listed once, when it is opened."""

    spark: SparkSession
    path: str
    metric: str
    centres: np.ndarray
    radius: np.ndarray
    vectors: DataFrame


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id BIGINT, embedding ARRAY<FLOAT>, cell INT").parquet(f"{path}/vectors")


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centre (ties: the smaller) and the distance to it."""
    squares = (centres * centres).sum(axis=1)
    cell = (squares - 2 * (vectors @ centres.T)).argmin(axis=1)
    return cell, np.sqrt(((vectors - centres[cell]) ** 2).sum(axis=1))


def _rows(batch: pa.RecordBatch, unit: bool) -> np.ndarray:
    rows = vector_matrix(batch.column("embedding")).astype(np.float64)
    return unit_rows(rows) if unit else rows


def _hash(column: str = "chunk_id"):
    return F.xxhash64(column)


def train_centres(vectors: DataFrame, cells: int, rounds: int = 8, metric: str = "ip") -> np.ndarray:
    """Centres of ``cells`` cells, fitted to a sample of at most about ``TRAIN_PER_CELL`` vectors per cell.

    The sample and the first centres are drawn by a hash of the ids; sums are of whole numbers: equal
    tables give equal centres. With fewer vectors than cells there are as many cells.
    """
    positive("cells", cells)
    unit = check_metric(metric) == "cosine"
    n = vectors.count()
    share = min(1.0, cells * TRAIN_PER_CELL / max(1, n))
    sample = vectors.where(F.pmod(_hash(), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select("chunk_id", "embedding")
    if not n:
        return np.empty((0, 0))
    few = vectors.where(F.pmod(_hash(), F.lit(n)) < 2 * cells) if n > 2 * cells else vectors
    drawn = few.orderBy(_hash(), "chunk_id").limit(cells).select("embedding").toArrow()
    centres = vector_matrix(drawn.column("embedding")).astype(np.float64)
    centres = unit_rows(centres) if unit else centres
    for _ in range(rounds):
        fixed = centres

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(fixed), np.int64)
            total = np.zeros(fixed.shape, np.int64)
            for batch in batches:
                if batch.num_rows:
                    rows = _rows(batch, unit)
                    cell, _ = _nearest(rows, fixed)
                    n += np.bincount(cell, minlength=len(n))
                    np.add.at(total, cell, np.rint(rows / GRAIN).astype(np.int64))
            some = np.flatnonzero(n)
            offsets = np.arange(len(some) + 1, dtype=np.int32) * fixed.shape[1]
            sums = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), sums], ["cell", "n", "sums"])

        parts = sample.mapInArrow(partial, "cell bigint, n bigint, sums array<bigint>")
        summed = (
            parts.select("cell", "n", F.posexplode("sums").alias("at", "x"))
            .groupBy("cell", "at")
            .agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
            .toArrow()
        )
        # As many rows as the centres have components.
        cell, at = (summed.column(c).to_numpy() for c in ("cell", "at"))
        moved = centres.copy()
        moved[cell, at] = summed.column("x").to_numpy() * GRAIN / summed.column("n").to_numpy()
        centres = unit_rows(moved) if unit else moved
    return centres


def build_inverted_file(
    vectors: DataFrame, path: str, cells: int | None = None, rounds: int = 8, metric: str = "ip"
) -> InvertedFile:
    """Store ``(chunk_id, embedding)`` by cell below ``path``; by default about the square root of n cells.

    Every vector is stored, as 32-bit floats. A cell with many vectors, be it a third of all, is spread over
    files of about ``ROWS_PER_FILE`` vectors.
    """
    spark = vectors.sparkSession
    unit = check_metric(metric) == "cosine"
    if cells is None:
        cells = max(1, math.isqrt(vectors.count()))
    first = vectors.select(F.size("embedding")).head()
    cells = min(cells, max(1, CENTRES_BYTES // (8 * max(1, first[0] if first else 1))))
    centres = train_centres(vectors, cells, rounds, metric)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, distance = _nearest(_rows(batch, unit), centres)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)],
                    ["chunk_id", "embedding", "cell", "distance"],
                )

    stored = vectors.select(F.col("chunk_id").cast("bigint"), F.col("embedding").cast("array<float>"))
    placed = stored.mapInArrow(assign, "chunk_id bigint, embedding array<float>, cell int, distance double")
    # One row per cell.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    radius = np.zeros(len(centres))
    for r in sizes:
        radius[r.cell] = r.radius
    files = spark.createDataFrame([(r.cell, math.ceil(r.n / ROWS_PER_FILE)) for r in sizes], "cell int, files int")
    spread = placed.join(F.broadcast(files), "cell").withColumn("file", F.pmod(_hash(), F.col("files")).cast("int"))
    spread = spread.repartition("cell", "file").select("chunk_id", "embedding", "cell")
    writer = spread.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.partitionBy("cell").parquet(f"{path}/vectors")
    table = [(i, metric, [float(x) for x in c], float(radius[i])) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, metric string, centre array<double>, radius double").write.mode("overwrite").parquet(
        f"{path}/centres"
    )
    return InvertedFile(spark, path, metric, centres, radius, _stored(spark, path))


def open_inverted_file(spark: SparkSession, path: str) -> InvertedFile:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    centres = np.array([r.centre for r in rows])
    metric = rows[0].metric if rows else "ip"
    return InvertedFile(spark, path, metric, centres, np.array([r.radius for r in rows]), _stored(spark, path))


def probe_order(index: InvertedFile, asked: np.ndarray) -> np.ndarray:
    """Per question all cells, the most promising first."""
    if index.metric == "cosine":
        return np.argsort(-(unit_rows(asked) @ index.centres.T), axis=1, kind="stable")
    return np.argsort(-(asked @ index.centres.T), axis=1, kind="stable")


def _hits(index: InvertedFile, query_ids: np.ndarray, asked: np.ndarray, probed: np.ndarray, k: int, digits: int) -> DataFrame:
    """Every task's best of the cells that each question probes; ``probed`` is a mask of questions x cells."""
    unit = index.metric == "cosine"
    cells = np.flatnonzero(probed.any(axis=0)).tolist()
    shipped = index.spark.sparkContext.broadcast((query_ids, unit_rows(asked) if unit else asked, probed))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked, probed = shipped.value
        best = RunningTopK(len(asked), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cell = batch.column("chunk_id").to_numpy(), batch.column("cell").to_numpy()
            rows = _rows(batch, unit)
            order = np.argsort(cell, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                some = np.flatnonzero(probed[:, cell[part[0]]])
                for at in range(0, len(some), 4096):
                    who = some[at : at + 4096]
                    best.offer(ids[part], round_half_up(rows[part] @ asked[who].T, digits), who)
        question, row_id, score = best.finish()
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[question]), pa.array(row_id), pa.array(score)], ["query_id", "chunk_id", "score"])

    # The folders of other cells are not listed, let alone read.
    return index.vectors.where(F.col("cell").isin(cells)).mapInArrow(job, HITS)


def topk(
    index: InvertedFile,
    questions: DataFrame,
    k: int = K_DENSE,
    probes: int = 8,
    digits: int = SCORE_DIGITS,
    max_bytes: int = BROADCAST_VECTOR_BYTES,
) -> DataFrame:
    """Best ``k`` among the vectors of each question's ``probes`` most promising cells.

    Scores are exact. Questions are shipped in slices of at most about ``max_bytes``; each slice reads the cells it probes.
    """
    positive("k_dense", k)
    positive("probes", probes)
    parts = []
    for query_ids, asked in question_slices(questions, max_bytes):
        if len(index.centres) and len(asked):
            probed = np.zeros((len(asked), len(index.centres)), bool)
            np.put_along_axis(probed, probe_order(index, asked)[:, :probes], True, axis=1)
            parts.append(_hits(index, query_ids, asked, probed, k, digits))
    return merge_best(_union(index.spark, parts), k)


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    found = spark.createDataFrame([], HITS)
    for i, part in enumerate(parts):
        found = part if i == 0 else found.union(part)
    return found


def score_bounds(index: InvertedFile, asked: np.ndarray) -> np.ndarray:
    """Questions x cells: what no vector of the cell can score above."""
    asked = unit_rows(asked) if index.metric == "cosine" else asked
    norms = np.sqrt((asked * asked).sum(axis=1, keepdims=True))
    return asked @ index.centres.T + norms * index.radius * (1 + 1e-9) + 1e-9


def exact_topk(
    index: InvertedFile,
    questions: DataFrame,
    k: int = K_DENSE,
    probes: int = 8,
    digits: int = SCORE_DIGITS,
    max_bytes: int = BROADCAST_VECTOR_BYTES,
) -> DataFrame:
    """The best ``k`` of all vectors: the same rows as the search without an index.

    First the ``probes`` most promising cells give each question a k-th score; then only cells whose bound reaches
    it are read. The k-th scores, a number per question of a slice, pass the driver.
    """
    positive("k_dense", k)
    parts = []
    for query_ids, asked, probed, rest in _two_steps(index, questions, k, probes, digits, max_bytes):
        parts.append(_hits(index, query_ids, asked, probed | rest, k, digits))
    return merge_best(_union(index.spark, parts), k)


def cells_read(index: InvertedFile, questions: DataFrame, k: int = K_DENSE, probes: int = 8) -> tuple[int, int]:
    """Over all questions, the pairs of question and cell that ``exact_topk`` reads, and all such pairs."""
    read = total = 0
    for _, _, probed, rest in _two_steps(index, questions, k, probes, SCORE_DIGITS, BROADCAST_VECTOR_BYTES):
        read, total = read + int((probed | rest).sum()), total + probed.size
    return read, total


def _two_steps(index, questions, k, probes, digits, max_bytes):
    for query_ids, asked in question_slices(questions, max_bytes):
        if not len(index.centres) or not len(asked):
            continue
        probed = np.zeros((len(asked), len(index.centres)), bool)
        np.put_along_axis(probed, probe_order(index, asked)[:, :probes], True, axis=1)
        first = merge_best(_hits(index, query_ids, asked, probed, k, digits), k)
        kth = first.where(F.col("rank") == k).select("query_id", "score").toArrow()
        floor = np.full(len(asked), -np.inf)
        order = np.argsort(query_ids)
        floor[order[np.searchsorted(query_ids[order], kth.column("query_id").to_numpy())]] = kth.column("score").to_numpy()
        # Scores are compared as rounded, so a bound must miss the floor by more than a rounding.
        rest = score_bounds(index, asked) >= floor[:, None] - 10.0**-digits
        yield query_ids, asked, probed, rest & ~probed


def calibrate(index: InvertedFile, sample: DataFrame, k: int = 10, recall: float = 0.95) -> int:
    """The least number of probes that finds ``recall`` of the true best ``k`` of a sample of questions.

    The sample, ``(query_id, embedding)``, is searched exactly; a hit counts from the number of probes on at
    which its cell is read.
    """
    places = []
    for query_ids, asked in question_slices(sample, BROADCAST_VECTOR_BYTES):
        if not len(index.centres) or not len(asked):
            continue
        order = probe_order(index, asked)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        ids = index.spark.createDataFrame([(int(q), i) for i, q in enumerate(query_ids)], "query_id bigint, at int")
        mine = sample.join(F.broadcast(ids.select("query_id")), "query_id", "left_semi")
        found = exact_topk(index, mine, k).join(index.vectors.select("chunk_id", "cell"), "chunk_id").join(F.broadcast(ids), "query_id")
        found = found.select("at", "cell").toArrow()
        places.append(place[found.column("at").to_numpy(), found.column("cell").to_numpy()])
    ranks = np.sort(np.concatenate(places)) if places else np.zeros(1, np.int64)
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1 if len(ranks) else 1

"""Vector tables and exact or approximate inner-product search."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.functions.topk import ProductTopK
from tarnsearch.functions.vectors import inner_product, l2_norm, rounded, unit_rows
from tarnsearch.operators.merge import merge_best
from tarnsearch.params import (
    BROADCAST_VECTOR_BYTES,
    K_DENSE,
    SCORE_DIGITS,
    check_metric,
    positive,
)

HITS = "query_id BIGINT, chunk_id BIGINT, score DOUBLE"


def as_vectors(df: DataFrame, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """The stored form: 64-bit id, 32-bit floats."""
    return df.select(
        F.col(id_col).cast("bigint").alias("chunk_id"),
        F.col(vector_col).cast("array<float>").alias("embedding"),
    )


def index_stats(vectors: DataFrame) -> DataFrame:
    """Number of stored vectors, smallest and largest width."""
    width = F.size("embedding")
    return vectors.agg(
        F.count("*").alias("n_vectors"), F.min(width).alias("min_dim"), F.max(width).alias("max_dim")
    )


def row_reasons(dim: int) -> Column:
    """Array of what is wrong with a row ``(chunk_id, embedding)`` on its own."""
    embedding = F.col("embedding")
    return F.array_compact(
        F.array(
            F.when(F.col("chunk_id").isNull(), "missing id"),
            F.when(embedding.isNull(), "missing vector"),
            F.when(F.size(embedding) != dim, "wrong dimension"),
            F.when(F.exists(embedding, lambda x: x.isNull() | F.isnan(x)), "missing element"),
        )
    )


def checked_rows(vectors: DataFrame, dim: int) -> DataFrame:
    """The same rows; one that an index of width ``dim`` must not take raises when it is read."""
    wrong = row_reasons(positive("dim", dim))
    named = F.coalesce(F.col("chunk_id").cast("string"), F.lit("null"))
    problem = F.raise_error(F.concat(F.lit("vector of chunk "), named, F.lit(": "), F.array_join(wrong, ", ")))
    return vectors.withColumn("embedding", F.when(F.size(wrong) > 0, problem.cast("array<float>")).otherwise(F.col("embedding")))


def vector_violations(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows an index of width ``dim`` must not take: one row per id and reason."""
    by_row = vectors.select("chunk_id", F.explode(row_reasons(positive("dim", dim))).alias("reason")).distinct()
    repeated = (
        vectors.filter("chunk_id IS NOT NULL")
        .groupBy("chunk_id")
        .count()
        .filter("count > 1")
        .select("chunk_id", F.lit("duplicate id").alias("reason"))
    )
    return by_row.unionByName(repeated)


def append_vectors(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Stored and added vectors. When the job runs, an id that is already there or comes twice, a missing id or
    vector, a missing element, and a width other than the stored one raise."""
    taken = stored.select("chunk_id", F.lit(True).alias("taken"))
    # One row: the stored width, or that of the first vectors.
    width = stored.agg(F.max(F.size("embedding")).alias("stored")).join(added.agg(F.max(F.size("embedding")).alias("new")))
    each = added.groupBy("chunk_id").agg(F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    named = F.coalesce(F.col("chunk_id").cast("string"), F.lit("null"))
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    wrong = (
        F.when(F.col("taken"), F.concat(F.lit("vector id already stored: "), named))
        .when(F.col("n") > 1, F.concat(F.lit("vector id added twice: "), named))
        .when(F.col("chunk_id").isNull(), F.lit("vector without an id"))
        .when(F.col("embedding").isNull(), F.concat(F.lit("missing vector: "), named))
        .when(size != F.coalesce("stored", "new"), F.concat(F.lit("width of vector "), named, F.lit(" is "), size.cast("string")))
        .when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), F.concat(F.lit("missing element in vector "), named))
    )
    checked = each.join(taken, "chunk_id", "left").join(F.broadcast(width)).withColumn("wrong", wrong)
    return stored.unionByName(
        checked.select(
            F.when(F.col("wrong").isNotNull(), F.raise_error(F.col("wrong")).cast("bigint")).otherwise(F.col("chunk_id")).alias("chunk_id"),
            "embedding",
        )
    )


def topk_single(
    vectors: DataFrame,
    query: Sequence[float],
    k: int = K_DENSE,
    metric: str = "ip",
    digits: int = SCORE_DIGITS,
) -> DataFrame:
    """Best ``k`` vectors for one query vector; each task sorts out its own first."""
    positive("k_dense", k)
    stored = F.col("embedding")
    asked = F.array(*(F.lit(float(x)).cast("float") for x in query))
    similarity = inner_product(stored, asked)
    if check_metric(metric) == "cosine":
        norms = l2_norm(stored) * l2_norm(asked)
        similarity = F.when(norms > 0, similarity / norms).otherwise(0.0)
    return (
        vectors.select("chunk_id", rounded(similarity, digits).alias("score"))
        .orderBy(F.desc("score"), "chunk_id")
        .limit(k)
    )


def vector_matrix(column: pa.Array) -> np.ndarray:
    """2-D view of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        return np.empty((0, 0), dtype=np.float32)
    if column.null_count or len(flat) % len(column):
        raise ValueError("vectors must share one width; see vector_violations")
    widths = np.diff(column.offsets.to_numpy())
    if len(np.unique(widths)) > 1:
        raise ValueError("vectors must share one width; see vector_violations")
    return flat.reshape(len(column), -1)


def _best_of_task(
    asked: np.ndarray,
    k: int,
    digits: int,
    batches: Iterator[pa.RecordBatch],
    unit: bool,
    allowed=None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = ProductTopK(unit_rows(asked) if unit else asked, k, digits)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
        block = vector_matrix(batch.column("embedding"))
        if len(asked) and block.shape[1] != asked.shape[1]:
            raise ValueError(f"query width {asked.shape[1]} differs from index width {block.shape[1]}")
        pairs = allowed(block, asked) if allowed and len(asked) else None
        best.offer(ids, unit_rows(block) if unit else block, pairs)
    return best.finish()


def question_slices(
    questions: DataFrame, max_bytes: int = BROADCAST_VECTOR_BYTES, dim: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of all questions, in slices of at most about ``max_bytes``: what a task is shipped at once."""
    if dim is None:
        first = questions.select(F.size("embedding")).head()
        dim = first[0] if first else 1
    limit = max(1, max_bytes // (8 * max(1, dim)))
    asked = questions.select("query_id", "embedding")
    # One row beyond the limit is enough to know that there are more slices.
    whole = asked.limit(limit + 1).toArrow()
    slices = 1 if whole.num_rows <= limit else math.ceil(asked.count() / limit)
    for i in range(slices):
        part = whole if slices == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i).toArrow()
        yield (
            part.column("query_id").to_numpy(),
            vector_matrix(part.column("embedding")).astype(np.float64),
        )


def topk(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = K_DENSE,
    metric: str = "ip",
    digits: int = SCORE_DIGITS,
    max_bytes: int = BROADCAST_VECTOR_BYTES,
    dim: int | None = None,
) -> DataFrame:
    """Exact best ``k`` vectors for each question ``(query_id, embedding)``.

    Pairs are scored as matrix blocks inside the tasks and never become rows: a
    task emits only its own best ``k`` per question. Vectors stay where they are read;
    questions are shipped to every task, in slices of at most about ``max_bytes``, each with
    its own pass over the vectors. ``dim`` saves a look at the questions where the caller knows it.
    """
    positive("k_dense", k)
    unit = check_metric(metric) == "cosine"
    return merge_best(all_hits(vectors, question_slices(questions, max_bytes, dim), k, digits, unit), k)


def all_hits(vectors: DataFrame, slices, k: int, digits: int, unit: bool = False, allowed=None) -> DataFrame:
    """Every task's own best ``k`` per question, over all slices of questions."""
    return reduce(DataFrame.union, (local_hits(vectors, part, k, digits, unit, allowed) for part in slices))


def local_hits(
    vectors: DataFrame,
    asked: tuple[np.ndarray, np.ndarray],
    k: int,
    digits: int,
    unit: bool = False,
    allowed=None,
) -> DataFrame:
    """Every task's own best ``k`` per question; ``unit`` compares directions only.

    ``allowed(vectors, questions)`` may return what says which pairs of them count.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(asked)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked = shipped.value
        question, row_id, score = _best_of_task(asked, k, digits, batches, unit, allowed)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[question]), pa.array(row_id), pa.array(score)],
            names=["query_id", "chunk_id", "score"],
        )

    return vectors.select("chunk_id", "embedding").mapInArrow(job, HITS)

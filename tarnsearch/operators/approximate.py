"""Approximate vector search: a question meets only vectors hashed like it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.operators.dense import all_hits, question_slices
from tarnsearch.operators.merge import merge_best
from tarnsearch.params import BROADCAST_VECTOR_BYTES, K_DENSE, SCORE_DIGITS, positive


def projection_buckets(vectors: np.ndarray, directions: np.ndarray, width: float) -> np.ndarray:
    """Bucket of every vector along every direction."""
    return np.floor(vectors.astype(np.float64) @ directions / width).astype(np.int32)


def lsh_topk(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = K_DENSE,
    bucket_width: float = 0.1,
    tables: int = 4,
    seed: int = 17,
    digits: int = SCORE_DIGITS,
    max_bytes: int = BROADCAST_VECTOR_BYTES,
) -> DataFrame:
    """Best ``k`` among the vectors in the question's bucket of at least one of ``tables``.

    Buckets are compared inside the tasks that hold the vectors. Nothing is shuffled by
    bucket, so one holding a third of all vectors makes no task larger than the others.
    Questions beyond ``max_bytes`` come in slices, with the same result.
    """
    positive("k_dense", k)
    positive("tables", tables)
    first = questions.select(F.size("embedding")).head()
    dim = first[0] if first else 1
    drawn = np.random.default_rng(seed).normal(size=(dim, tables))
    directions = drawn / np.linalg.norm(drawn, axis=0)

    def allowed(stored: np.ndarray, asked: np.ndarray):
        own = projection_buckets(stored, directions, bucket_width)
        wanted = projection_buckets(asked, directions, bucket_width)

        def pairs(rows: slice, cols: slice) -> np.ndarray:
            here, there = own[rows], wanted[cols]
            match = np.zeros((len(here), len(there)), dtype=bool)
            for table in range(tables):
                match |= here[:, table, None] == there[None, :, table]
            return match

        return pairs

    return merge_best(all_hits(vectors, question_slices(questions, max_bytes, dim), k, digits, allowed=allowed), k)

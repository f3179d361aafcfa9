"""Score (question, chunk) pairs and keep the best."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsearch.functions.text import tokens
from tarnsearch.functions.vectors import rounded
from tarnsearch.params import K_FINAL, PAIR_BATCH, SCORE_DIGITS, positive
from tarnsearch.plans.work import spread

ScorePairs = Callable[[Sequence[tuple[str, str]]], np.ndarray]


def score_pairs(
    candidates: DataFrame,
    load: Callable[[], ScorePairs],
    batch_size: int = PAIR_BATCH,
) -> DataFrame:
    """Add ``score`` from a model; ``load()`` runs once per task and returns the scorer."""
    positive("batch_size", batch_size)
    at_query = candidates.columns.index("query")
    at_text = candidates.columns.index("text")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load()
        for batch in batches:
            pairs = list(zip(batch.column(at_query).to_pylist(), batch.column(at_text).to_pylist()))
            parts = [
                np.asarray(score(pairs[i : i + batch_size]), dtype=np.float64)
                for i in range(0, len(pairs), batch_size)
            ]
            scores = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"]
            )

    schema = T.StructType([*candidates.schema.fields, T.StructField("score", T.DoubleType())])
    return spread(candidates, "query_id", "chunk_id").mapInArrow(job, schema)


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def overlap_score(asked: Column, text: Column) -> Column:
    """Stand-in for a model: share of the question's distinct terms found in the chunk."""
    shared = F.size(F.array_intersect(asked, tokens(text)))
    return F.when(F.size(asked) > 0, shared / F.size(asked)).otherwise(0.0)


def rerank_topk(
    scored: DataFrame, k_final: int = K_FINAL, digits: int = SCORE_DIGITS
) -> DataFrame:
    """Best ``k_final`` per question by ``score``, ranked anew from 1."""
    positive("k_final", k_final)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        scored.withColumn("score", rounded(F.col("score"), digits))
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= k_final)
    )

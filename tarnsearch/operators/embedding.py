"""Turn texts into vectors with a model the caller supplies."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnsearch.functions.text import tokenize
from tarnsearch.functions.vectors import unit_rows
from tarnsearch.params import EMBED_BATCH, positive

# Texts of an Arrow batch that a task holds as strings and vectors before it hands the vectors on.
HELD_TEXTS = 1024
# Terms whose buckets a task of the stand-in remembers.
HELD_TERMS = 1 << 17

Encode = Callable[[Sequence[str]], np.ndarray]


@dataclass(frozen=True)
class Embedder:
    """A named model: ``load()`` runs once per task and returns texts -> (n, dim) array."""

    name: str
    dim: int
    load: Callable[[], Encode]
    normalize: bool = True


def hash_embedder(dim: int = 256, normalize: bool = True) -> Embedder:
    """Deterministic stand-in for a model: term counts hashed into ``dim`` buckets."""
    positive("dim", dim)

    def load() -> Encode:
        buckets: dict[str, int] = {}

        def bucket(term: str) -> int:
            if term not in buckets:
                if len(buckets) >= HELD_TERMS:
                    buckets.clear()
                buckets[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim
            return buckets[term]

        def encode(texts: Sequence[str]) -> np.ndarray:
            vectors = np.zeros((len(texts), dim))
            for row, text in zip(vectors, texts):
                counted = Counter(tokenize(text))
                places = np.fromiter(map(bucket, counted), np.int64, len(counted))
                row[:] = np.bincount(places, np.fromiter(counted.values(), np.float64, len(counted)), dim)
            return vectors

        return encode

    return Embedder(f"hash-{dim}", dim, load, normalize)


def vector_array(vectors: np.ndarray) -> pa.Array:
    """Arrow list<float> column of a 2-D array, without a Python object per row."""
    n, dim = vectors.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim) if dim else np.zeros(n + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.astype(np.float32).ravel()))


def _vectors(
    batches: Iterator[pa.RecordBatch], embedder: Embedder, id_col: str, batch_size: int
) -> Iterator[pa.RecordBatch]:
    encode = embedder.load()
    step = batch_size * max(1, HELD_TEXTS // batch_size)
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            some = batch.slice(first, step)
            column = some.column(1).to_pylist()
            parts = []
            for start in range(0, len(column), batch_size):
                part = np.asarray(encode([t or "" for t in column[start : start + batch_size]]))
                if part.ndim != 2 or part.shape[1] != embedder.dim:
                    raise ValueError(f"{embedder.name}: expected (n, {embedder.dim}), got {part.shape}")
                parts.append(unit_rows(part) if embedder.normalize else part)
            yield pa.RecordBatch.from_arrays([some.column(0), vector_array(np.vstack(parts))], names=[id_col, "embedding"])


def embed(
    texts: DataFrame,
    embedder: Embedder,
    id_col: str = "chunk_id",
    text_col: str = "text",
    batch_size: int = EMBED_BATCH,
) -> DataFrame:
    """Rows ``(id, embedding)``; the model sees ``batch_size`` texts at a time."""
    positive("batch_size", batch_size)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _vectors(batches, embedder, id_col, batch_size)

    schema = T.StructType(
        [
            T.StructField(id_col, texts.schema[id_col].dataType),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
        ]
    )
    return texts.select(id_col, text_col).mapInArrow(job, schema)

"""Split documents into overlapping chunks and number them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsearch.functions.splitting import split_text
from tarnsearch.functions.text import strip
from tarnsearch.params import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS, check_chunking
from tarnsearch.plans.work import materialize, materialize_in_buckets

# Texts that a task splits before it hands their pieces on.
SPLIT_TEXTS = 256


def _fixed_pieces(text: Column, size: int, overlap: int) -> Column:
    """Character windows in closed form, without leaving the JVM."""
    step = size - overlap
    length = F.length(text)
    last = F.when(length <= size, 0).otherwise(F.ceil((length - overlap) / step) - 1)
    starts = F.sequence(F.lit(0), last.cast("int"))
    pieces = F.transform(starts, lambda i: strip(F.substr(text, i * step + 1, F.lit(size))))
    return F.filter(pieces, lambda piece: piece != "")


def _splitter(size: int, overlap: int, separators: Sequence[str]):
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for start in range(0, len(texts), SPLIT_TEXTS):
                some = (text.as_py() for text in texts[start : start + SPLIT_TEXTS])
                found = [None if text is None else split_text(text, size, overlap, separators) for text in some]
                yield pa.array(found, pa.list_(pa.string()))

    return split


def _recursive_pieces(text: Column, size: int, overlap: int, separators: Sequence[str]) -> Column:
    return F.arrow_udf(_splitter(size, overlap, separators), "array<string>")(text)


def pieces(
    text: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
) -> Column:
    """Array of the chunks of a text."""
    check_chunking(size, overlap, separators)
    if tuple(separators) == ("",):
        return _fixed_pieces(text, size, overlap)
    return _recursive_pieces(text, size, overlap, tuple(separators))


def split_documents(
    documents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
    text_col: str = "text",
) -> DataFrame:
    """One row per chunk, carrying its document's columns and ``chunk_pos`` from 0.

    A document without text other than white space gives no chunk.
    """
    inherited = [c for c in documents.columns if c != text_col]
    split = documents.withColumn(text_col, pieces(F.col(text_col), size, overlap, separators))
    return split.select(*inherited, F.posexplode(text_col).alias("chunk_pos", text_col))


def _numbered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition's number and each row's place in it."""
    block, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(rows, block, np.int32)), pa.array(np.arange(place, place + rows))],
            names=[*batch.schema.names, "_block", "_place"],
        )
        place += rows


def _count_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row of a sorted partition the partition's number and the chunks before the row in it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = batch.column("_chunks").to_numpy().astype(np.int64)
        ends = before + np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_block"),
                batch.column("_place"),
                batch.column("_chunks"),
                pa.array(np.full(len(sizes), part, np.int32)),
                pa.array(ends - sizes),
            ],
            names=["_block", "_place", "_chunks", "_part", "_before"],
        )
        before = int(ends[-1]) if len(ends) else before


COUNTED = "_block int, _place bigint, _chunks int, _part int, _before bigint"


def _first_numbers(sizes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per block an array: of each of its documents, in their places, how many chunks all documents earlier
    in ``order`` have. ``sizes`` is narrow, and it is all that is sorted."""
    counted = materialize(
        sizes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_count_before, COUNTED), "counted"
    )
    # One row per partition, so this window is bounded by the number of tasks.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy("_part")
        .agg(F.sum("_chunks").alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    )
    first = F.struct("_place", (F.col("_offset") + F.col("_before")).alias("first"))
    return (
        counted.join(F.broadcast(offsets), "_part")
        .groupBy("_block")
        .agg(F.sort_array(F.collect_list(first)).alias("_firsts"))
        .select("_block", F.col("_firsts.first").alias("_firsts"))
    )


def number_chunks(
    documents: DataFrame,
    order: Sequence[str],
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
    text_col: str = "text",
    first_id: int = 0,
) -> DataFrame:
    """Chunks with a dense ``chunk_id`` running over all documents in ``order``.

    ``order`` must tell any two documents apart. Texts are split where they are read and written in buckets, a
    bucket per task; only (order, number of chunks) is sorted and summed up, and the first numbers come back
    to the buckets as one array per block, whose length is that of a task's documents. No text is shuffled.
    """
    inherited = [c for c in documents.columns if c != text_col]
    split = documents.withColumn(text_col, pieces(F.col(text_col), size, overlap, separators))
    placed = T.StructType(
        [*split.schema.fields, T.StructField("_block", T.IntegerType()), T.StructField("_place", T.LongType())]
    )
    # Written, because the place of a row is a fact about one run.
    split = materialize_in_buckets(split.mapInArrow(_numbered_rows, placed), "split", "_block")
    chunks = F.coalesce(F.size(text_col), F.lit(0)).alias("_chunks")
    firsts = _first_numbers(split.select(*order, "_block", "_place", chunks), order)
    first = F.element_at("_firsts", (F.col("_place") + 1).cast("int")).alias("_first")
    return (
        split.join(firsts.hint("shuffle_hash"), "_block")
        # The document's own number is taken out first: only it goes along with every chunk.
        .select(first, *inherited, text_col)
        .select("_first", *inherited, F.posexplode(text_col).alias("chunk_pos", text_col))
        .select(
            (F.col("_first") + F.col("chunk_pos") + first_id).alias("chunk_id"), *inherited, "chunk_pos", text_col
        )
    )

"""Documents arriving as a stream are taken into a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tarnsearch.operators.embedding import Embedder
from tarnsearch.plans.index import Settings, build_index, open_index, refresh_index


def ingest(
    documents: DataFrame,
    root: str,
    embedder: Embedder,
    checkpoint: str,
    stream: str,
    settings: Settings | None = None,
    **trigger,
) -> StreamingQuery:
    """Start a stream of ``(doc_id, source_path, text)`` into the index under ``root``.

    Every micro-batch that brings something becomes one version: new documents are added, known ones with
    another content or path replaced. A batch that is delivered again, after a failure or from
    a fresh checkpoint, differs from the index in nothing and makes no version. A
    document must come once per batch: repeated ids raise.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = open_index(spark, root)
        if index is None:
            build_index(batch, root, embedder, settings, stream, batch_id)
        else:
            refresh_index(
                index, batch, embedder, settings, remove_missing=False, stream=stream, batch=batch_id
            )

    writer = documents.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

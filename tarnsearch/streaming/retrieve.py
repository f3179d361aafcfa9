"""Questions arriving as a stream are answered from a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tarnsearch.operators.embedding import Embedder
from tarnsearch.plans.hybrid import retrieve
from tarnsearch.plans.index import open_index


def answer_stream(
    questions: DataFrame,
    root: str,
    embedder: Embedder,
    output: str,
    checkpoint: str,
    limits: dict | None = None,
    **trigger,
) -> StreamingQuery:
    """Write the candidates of each micro-batch of ``(query_id, query)`` to its own folder.

    The newest version of the index is opened per batch. A batch delivered again
    overwrites its folder, so every question has its candidates once.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        index = open_index(batch.sparkSession, root)
        if index is None:
            raise ValueError(f"no index under {root}")
        hits = retrieve(index.corpus(embedder), batch, **(limits or {}))
        hits.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

"""From ranked chunks to prompts, answers and source lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsearch.functions.text import strip
from tarnsearch.params import MAX_CONTEXT_CHARS, positive
from tarnsearch.plans.work import spread

Generate = Callable[[Sequence[Sequence[dict]]], Sequence[str]]


def _known_source(fallback: str) -> Column:
    """The source, or the fallback where it is missing or empty."""
    return F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit(fallback))


def context_piece() -> Column:
    """Header and body of one chunk as the prompt shows it."""
    # Fixed value: the header line.
    return F.concat(
        F.lit("### Source: "),
        _known_source("unknown_source"),
        F.lit(" | chunk_id: "),
        F.col("chunk_id").cast("string"),
        F.lit("\n"),
        strip(F.coalesce(F.col("text"), F.lit(""))),
    )


def pack_context(ranked: DataFrame, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """Pieces in rank order up to the first that would exceed ``max_chars``.

    A later, shorter piece is not tried: a piece always has its header, so the running
    sum grows with every row. The blank lines joining pieces do not count.
    """
    positive("max_context_chars", max_chars)
    so_far = (
        Window.partitionBy("query_id")
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranked.withColumn("piece", context_piece())
        .withColumn("used_chars", F.sum(F.length("piece")).over(so_far))
        .filter(F.col("used_chars") <= max_chars)
    )


def collect_contexts(ranked: DataFrame) -> DataFrame:
    """One list per question, in rank order; at most ``k_final`` entries each."""
    context = F.struct("rank", "chunk_id", "source", "text", "score")
    return ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(context)).alias("contexts"))


def build_prompt(
    questions: DataFrame,
    ranked: DataFrame,
    system_prompt: str,
    max_chars: int = MAX_CONTEXT_CHARS,
) -> DataFrame:
    """System and user message per question; a question without context keeps its prompt."""
    blocks = (
        pack_context(ranked, max_chars)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "piece"))).alias("pieces"))
        .select("query_id", F.array_join(F.col("pieces.piece"), "\n\n").alias("context"))
    )
    # Fixed value: the layout of the user message.
    user = F.concat(
        F.lit("CONTEXT:\n"),
        F.coalesce(F.col("context"), F.lit("")),
        F.lit("\n\nQUESTION:\n"),
        F.col("query"),
        F.lit("\n\n"),
    )
    return questions.join(blocks, "query_id", "left").select(
        "query_id",
        "query",
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
            F.struct(F.lit("user").alias("role"), user.alias("content")),
        ).alias("messages"),
    )


def generate(
    prompts: DataFrame, load: Callable[[], Generate], batch_size: int = 8
) -> DataFrame:
    """Add ``answer`` from a model; ``load()`` runs once per task."""
    positive("batch_size", batch_size)
    at = prompts.columns.index("messages")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = load()
        for batch in batches:
            messages = batch.column(at).to_pylist()
            answers: list[str] = []
            for i in range(0, len(messages), batch_size):
                answers += [text.strip() for text in answer(messages[i : i + batch_size])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(answers, pa.string())],
                names=[*batch.schema.names, "answer"],
            )

    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType())])
    return spread(prompts, "query_id").mapInArrow(job, schema)


def assemble_answers(
    questions: DataFrame,
    ranked: DataFrame,
    answers: DataFrame | None = None,
    gen_config: Mapping[str, str] | None = None,
    model_id: str | None = None,
) -> DataFrame:
    """One row per question: answer, contexts, query, gen_config, model_id.

    ``answers`` has ``(query_id, answer)``; without it the answer is null.
    """
    rows = questions.select("query_id", "query").join(
        collect_contexts(ranked), "query_id", "left"
    )
    if answers is None:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    else:
        rows = rows.join(answers.select("query_id", "answer"), "query_id", "left")
    settings = [F.lit(str(x)) for pair in (gen_config or {}).items() for x in pair]
    config = F.create_map(*settings) if settings else F.lit(None)
    return rows.select(
        "query_id",
        "query",
        "answer",
        F.coalesce("contexts", F.array().cast(rows.schema["contexts"].dataType)).alias("contexts"),
        config.cast("map<string,string>").alias("gen_config"),
        F.lit(model_id).cast("string").alias("model_id"),
    )


def sources_report(answered: DataFrame) -> DataFrame:
    """Source, chunk and score of every context of every answer, in rank order."""
    return answered.select("query_id", F.explode("contexts").alias("c")).select(
        "query_id", F.col("c.*")
    ).select("query_id", "rank", _known_source("unknown").alias("source"), "chunk_id", "score")
